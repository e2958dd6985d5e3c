"""Sources: files and payloads as rows of the engine's shapes."""

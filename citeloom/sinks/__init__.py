"""What leaves the engine: payloads, reports and pictures, as text columns to be written."""

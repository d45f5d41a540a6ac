"""Column-level pieces: colour maths and text parsing."""

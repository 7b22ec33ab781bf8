"""Structured Streaming counterparts of the fixed grid, the pair mean's count window and the gap-separated episodes."""

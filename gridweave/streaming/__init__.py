"""Tensors that arrive as streams."""

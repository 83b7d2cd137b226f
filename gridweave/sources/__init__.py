"""Where tensors come from and go to."""

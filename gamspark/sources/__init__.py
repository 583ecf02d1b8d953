"""Dataset declarations, readers and writers."""

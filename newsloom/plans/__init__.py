"""newsloom plans."""

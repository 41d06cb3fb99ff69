"""Row-generating operators of views."""

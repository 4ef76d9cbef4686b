"""Runnable jobs: each a function over a session and plain paths, a command line and a configuration beside it."""

"""Runnable jobs. Each is a function that takes a session and plain paths; its module's command line makes the session."""

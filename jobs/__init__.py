"""Runnable jobs: python -m jobs.<name> --config FILE, with paths as arguments."""

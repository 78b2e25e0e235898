"""Rows for the tests."""

from lumenfold.sources.demo import NAMES, SCHEMA, at, demo, demo_photos, frame, photo

__all__ = ["NAMES", "SCHEMA", "at", "demo", "demo_photos", "frame", "photo"]

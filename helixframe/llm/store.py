"""Scratch tables of the training-data operators: the library's own."""

from helixframe.scratch import bucketed, discard, materialise, new_path, release, scratch_root

__all__ = ["bucketed", "discard", "materialise", "new_path", "release", "scratch_root"]

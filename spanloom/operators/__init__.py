"""Interval, timing, cue, packing and state operators."""

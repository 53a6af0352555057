"""Stages that also run on streams."""

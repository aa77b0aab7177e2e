"""Batch operators: frames in, frames out."""

"""Readers and writers: observation logs, run settings, review sheets, caption files, frames."""

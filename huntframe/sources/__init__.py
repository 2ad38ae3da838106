"""Readers, codecs, tables and sinks."""

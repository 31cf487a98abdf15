"""Parsing of source files with bundled grammars."""

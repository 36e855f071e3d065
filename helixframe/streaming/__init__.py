"""Streams: new structure files, frames against static topology, windows over events, running counts."""

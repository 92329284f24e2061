"""Loads of public-format source files: programs are transforms of frames, the framework gates, audits and reverts them."""

"""Readers and writers: landed files in, clean tables and result sets out."""
from popgauge.sources.files import *  # noqa: F401,F403
from popgauge.sources.lines import numbered_lines, read_sheet  # noqa: F401

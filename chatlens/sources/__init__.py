"""Readers, writers and conversation samplers."""

from chatlens.sources.sampling import sample_by_ids, sample_top_conversations
from chatlens.sources.scratch import scratch_path, shared_folder
from chatlens.sources.tables import (
    read_annotations,
    read_chat_log,
    register_views,
    rename_positional,
    write_table,
)

__all__ = [
    "read_annotations",
    "read_chat_log",
    "register_views",
    "rename_positional",
    "sample_by_ids",
    "sample_top_conversations",
    "scratch_path",
    "shared_folder",
    "write_table",
]

"""Queries over the driver's tables: name -> function, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import caption_plans, channel_plans, frame_plans, interval_plans, join_plans, library_plans, lift_plans, model_plans, moment_plans, registry_plans, scalar_plans, sequence_plans, slot_plans, source_plans, speech_plans, stream_plans, style_plans, title_plans, transcript_plans  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

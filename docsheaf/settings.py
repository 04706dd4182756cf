"""Thresholds of the operators. They must equal those of the analysed system for equal results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    native_min_chars: int = 24
    sparse_overlay_chars: int = 120
    render_dpi: int = 200
    max_image_edge: int = 3072
    max_image_pixels: int = 8_000_000
    visual_pages: int = 60
    max_visual_pages: int = 200
    tile_size: int = 1536
    tile_overlap: float = 0.125
    tile_min_source_edge: int = 2048
    max_tiles: int = 48
    blank_pixel_ratio: float = 0.00002
    blank_tolerance: int = 24
    dedupe_min_chars: int = 6
    merge_iou: float = 0.5
    merge_containment: float = 0.8
    drawing_min_raster_area: float = 0.02
    drawing_min_vector_operations: int = 100
    max_viewed_pages: int = 12
    analyze_pages_per_call: int = 10
    max_analyzed_pages: int = 60
    analyze_group_max: int = 10
    vision_max_tokens: int = 4096
    budget_answer: int = 8000
    budget_grounding: int = 4000
    budget_ocr: int = 4000
    repeat_lines: int = 8
    repeat_count: int = 3
    repeat_min_chars: int = 24
    max_actions: int = 60
    ocr_retries: int = 3
    ocr_cache: int = 256
    max_regions: int = 200
    max_tool_steps: int = 8
    repeated_calls: int = 3
    max_continuations: int = 8
    max_attachments: int = 12
    max_document_chars: int = 8_000_000
    max_images: int = 12
    max_history: int = 30
    context_tokens: int = 8192
    cloud_chars: int = 600_000
    cloud_attachment_chars: int = 180_000
    trace_text: int = 40_000


DEFAULTS = Settings()

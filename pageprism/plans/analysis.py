"""Queries for tracking tags, scores and classification."""

from __future__ import annotations

from ..operators import scoring as S
from ..operators import trackers as T
from .extraction import on_pages

QUERIES = {
    "tracker_class": on_pages(T.tracker_class, "scripts"),
    "tracker_ga": on_pages(T.tracker_ga, "scripts"),
    "tracker_gtm": on_pages(lambda p: T.tracker_ids(p, "google_tag_manager", "container_id"), "scripts"),
    "tracker_fb": on_pages(lambda p: T.tracker_ids(p, "facebook_pixel", "pixel_id"), "scripts"),
    "tracker_hotjar": on_pages(lambda p: T.tracker_ids(p, "hotjar", "site_id"), "scripts"),
    "tracker_mixpanel": on_pages(lambda p: T.tracker_ids(p, "mixpanel", "project_token"), "scripts"),
    "tracker_other": on_pages(T.tracker_other, "scripts"),
    "social_meta": on_pages(T.social_meta, "metas"),
    "tracker_summary": on_pages(T.tracker_summary, "scripts", "metas"),
    "tracking_intensity": on_pages(T.tracking_intensity, "scripts", "metas"),
    "privacy_flag": on_pages(T.privacy_flag, "scripts", "metas"),
    "content_overview": on_pages(S.content_overview),
    "seo_presence": on_pages(S.seo_presence),
    "content_richness": on_pages(S.content_richness),
    "technical_counts": on_pages(S.technical_counts),
    "heading_structure": on_pages(S.heading_structure),
    "content_type": on_pages(S.content_types),
    "content_depth": on_pages(S.content_depth),
    "link_category": on_pages(S.link_category, "anchors"),
    "link_stats": on_pages(S.link_stats),
    "media_stats": on_pages(S.media_stats),
    "performance_score": on_pages(S.performance_score),
    "performance_insights": on_pages(S.performance_insights),
    "optimization_opps": on_pages(S.optimization_opps),
    "recommendations_gen": on_pages(S.recommendation_rows),
    "health_score": on_pages(S.health_score),
    "page_analysis": on_pages(S.page_analysis),
    "quick_summary": on_pages(S.quick_summary),
}

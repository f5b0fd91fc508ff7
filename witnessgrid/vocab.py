"""Closed vocabularies and configured limits.

Fixed values: every list and constant in this module has to equal what existing data and
reports already use, so they are stated plainly and in their natural order.
"""

from __future__ import annotations

STATUSES = ("pending", "in_progress", "completed", "failed")

EVIDENCE_TYPES = (
    "object", "scene", "ocr_text", "activity", "environment", "topic", "brand", "team",
    "religious_content", "social_context", "other_observable",
)

AGGREGATION_KINDS = EVIDENCE_TYPES + ("semantic_theme",)

THEME_TYPES = (
    "recurring_content", "visible_interest", "activity", "environment", "brand_team",
    "religious_content", "social_context", "textual_reference", "other_observable",
)

INSIGHT_TYPES = (
    "recurring_theme", "visible_interest", "activity", "environment", "content_pattern",
    "social_context", "brand_reference", "team_reference", "textual_reference",
    "religious_content",
)

OBSERVATION_KINDS = ("scene", "object", "activity", "topic")

EVAL_LABEL_TYPES = (
    "object", "scene", "ocr_text", "activity", "environment", "topic", "visible_interest",
    "brand", "team", "religious_content", "recurring_content", "social_context",
)

VISUAL_LABEL_TYPES = ("object", "scene", "activity", "topic")

SLICES = (
    "persian_heavy", "english_heavy", "mixed_persian_english", "text_heavy", "low_quality",
    "screenshot", "meme", "group", "no_text", "indoor", "outdoor",
)

LANGUAGE_SLICES = ("persian_heavy", "english_heavy", "mixed_persian_english")

UNSUPPORTED_CATEGORIES = (
    "person_religion", "political_orientation", "ethnicity", "mental_health",
    "sexual_orientation", "intelligence", "honesty", "family_relationship",
    "personality_trait",
)

CLAIM_CATEGORIES = (
    "religion", "political_orientation", "ethnicity", "mental_health", "sexual_orientation",
    "personality", "intelligence", "other_self_description",
)

CLAIM_SOURCE_TYPES = ("questionnaire", "bio", "post", "direct_statement", "other")

TRAITS = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")

CLAIM_BASIS = "explicit_self_report"
QUESTIONNAIRE_BASIS = "explicit_self_report_questionnaire"
QUESTIONNAIRE_MODEL = "big_five_self_report_scoring_v1"

# aggregation kind -> (insight type, label prefix); semantic_theme has no rule on purpose.
INSIGHT_RULES = {
    "object": ("content_pattern", "Recurring object"),
    "scene": ("environment", "Recurring scene"),
    "ocr_text": ("textual_reference", "Recurring textual reference"),
    "activity": ("activity", "Recurring visible activity"),
    "environment": ("environment", "Recurring environment"),
    "topic": ("visible_interest", "Recurring topic-related content"),
    "brand": ("brand_reference", "Recurring brand reference"),
    "team": ("team_reference", "Recurring team reference"),
    "religious_content": ("religious_content", "Recurring religious-themed content"),
    "social_context": ("social_context", "Recurring visible social context"),
    "other_observable": ("content_pattern", "Recurring observable content"),
}

EMPTY_SUMMARY = "No supported insights met the configured evidence policy."
SUMMARY_PREFIX = "Supported insights: "

SENSITIVE_KEYS = (
    "religion", "person_religion", "political_orientation", "person_political_orientation",
    "ethnicity", "person_ethnicity", "mental_health", "person_mental_health",
    "sexual_orientation", "person_sexual_orientation", "intelligence", "person_intelligence",
    "honesty", "person_honesty", "family_relationship", "person_family_relationship",
    "personality_trait", "personality_traits", "inner_personality",
)

SENSITIVE_PHRASES = (
    "religion", "political orientation", "political ideology", "ethnicity", "mental health",
    "sexual orientation", "intelligence", "honesty", "family relationship",
    "personality trait", "inner personality",
    "مذهب", "دین", "گرایش سیاسی", "ایدئولوژی سیاسی", "قومیت", "سلامت روان", "گرایش جنسی",
    "هوش", "صداقت", "رابطه خانوادگی", "نسبت خانوادگی", "ویژگی شخصیتی", "صفات شخصیتی",
    "شخصیت درونی",
)

SUBJECT_TERMS = (
    "person", "user", "subject", "individual", "owner", "profile owner",
    "شخص", "فرد", "کاربر", "سوژه", "صاحب پروفایل", "صاحب حساب",
)

MIME_BY_EXTENSION = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp",
}
ALLOWED_MIME_TYPES = ("image/jpeg", "image/png", "image/webp")

MAX_ITEMS_PER_ANALYSIS = 50
MAX_ITEM_BYTES = 12 * 1024 * 1024
MAX_ITEM_PIXELS = 40_000_000
MAX_DIMENSION = 2048
MAX_CLAIMS = 50
MAX_CLAIM_CHARS = 256
MAX_QUESTIONNAIRE_ITEMS = 100
MAX_OBSERVATIONS_PER_KIND = 3
MAX_LABEL_CHARS = 64
MAX_CAPTION_CHARS = 160
THEME_THRESHOLD = 0.25
NEAR_DUPLICATE_THRESHOLD = 0.95

RESULT_SCHEMA_V1 = "phase9-analysis-result-v1"
RESULT_SCHEMA_V2 = "profile-analysis-result-v2"
RESULT_SCHEMA_V3 = "profile-analysis-result-v3"

OCR_ID_TAG = "phase4-ocr-evidence-v1"
VISUAL_ID_TAG = "phase5-visual-evidence-v1"
NEAR_DUPLICATE_TAG = "phase6-near-duplicate-v1"
SEMANTIC_ID_TAG = "phase7-semantic-support-v1"

EVALUATOR_VERSION = "phase2-evaluator-1.1.0"
REPORT_SCHEMA_VERSION = "1.1.0"
VISION_REPORT_SCHEMA = "phase10-siglip-zero-shot-vision-benchmark-v1"
SELECTED_TEXT_CANDIDATE = "tessdata_best"

"""Vocabularies and tables that results depend on.

Fixed values, stated as they must be matched; every operator takes them as a parameter.
"""

from __future__ import annotations

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif")

#: Refusal phrases by tier; a lower tier counts only if no higher one matched.
REFUSAL_HIGH = (
    "i cannot", "i can't", "i apologize", "i'm sorry", "cannot provide", "cannot assist", "cannot help", "unable to",
    "not able to", "i decline", "无法提供", "不能提供", "无法协助", "不能协助", "抱歉", "对不起", "很抱歉", "十分抱歉",
    "我无法", "我不能", "不便提供",
)
REFUSAL_MEDIUM = (
    "inappropriate", "offensive", "explicit", "nsfw", "against policy", "against guidelines", "not appropriate",
    "uncomfortable", "cannot comply", "不合适", "不适当", "不恰当", "违反", "不符合", "敏感内容", "不便", "无法满足",
)
REFUSAL_LOW = ("policy", "guidelines", "terms", "ethical", "政策", "准则", "规定", "伦理")
REFUSAL_FLAT = (
    "i cannot", "i can't", "i apologize", "i'm sorry", "cannot provide", "unable to", "无法提供", "不能提供", "抱歉",
    "对不起", "我无法", "我不能",
)
LEVEL_HIGH, LEVEL_MEDIUM, LEVEL_LOW = "高", "中", "低"

#: Words that open a sentence of a caption after tags, and patterns of verbs of one. These are fixed values, stated as
#: they are: which texts are split, and where, follows from them.
CAPTION_STARTERS = (
    "Shot", "Seen", "Framed", "Depicted", "Viewed", "Rendered", "A", "An", "The", "She", "He", "It", "This", "That",
    "Her", "His", "In", "From", "Against", "Atop", "Beneath", "Under", "Above", "Standing", "Sitting", "Kneeling",
    "Wearing", "Holding", "Gripping", "Looking", "Gazing", "Staring",
)
CAPTION_VERBS = (
    "depicts?", "shows?", "features?", "portrays?", "stands?", "standing", "sits?", "sitting", "kneels?", "kneeling",
    "looks?", "looking", "wears?", "wearing", "holds?", "holding", "grips?", "gripping", "smiles?", "smiling", "glows?",
    "glowing", "gazes?", "gazing", "stares?", "staring", "billows?", "billowing", "floats?", "floating", "is", "are", "was",
    "were",
)

#: Tags of layouts that harm training.
LAYOUT_TAGS = (
    "multiple views", "multiple_views", "character sheet", "character_sheet", "reference sheet", "reference_sheet",
    "comic", "4koma", "comic strip", "sequence", "turnaround", "expression chart", "expression_chart", "variations",
    "panel layout",
)
#: Persons that a tag states; the first of the largest counts.
PERSON_TAGS = {
    "2girls": 2, "2boys": 2, "2others": 2, "3girls": 3, "3boys": 3, "3others": 3, "4girls": 4, "4boys": 4,
    "4others": 4, "5girls": 5, "5boys": 5, "5others": 5, "6+girls": 6, "6+boys": 6, "multiple girls": 2,
    "multiple_girls": 2, "multiple boys": 2, "multiple_boys": 2,
}
WATERMARK_TAGS = (
    "watermark", "text", "username", "web address", "web_address", "patreon username", "patreon_username",
    "twitter username", "twitter_username", "pixiv id", "pixiv_id", "artist name", "artist_name", "signature",
    "copyright notice", "copyright_notice", "logo", "english text", "english_text", "url", "sample watermark",
)
#: Composition of a tag; the first entry that matches counts.
COMPOSITION_TAGS = {
    "full body": "full_body", "full_body": "full_body", "upper body": "upper_body", "upper_body": "upper_body",
    "lower body": "lower_body", "lower_body": "lower_body", "cowboy shot": "cowboy_shot", "cowboy_shot": "cowboy_shot",
    "portrait": "portrait", "close-up": "close_up", "close up": "close_up", "face focus": "face_focus",
    "face_focus": "face_focus", "bust": "bust", "half body": "upper_body",
}

#: What a hit of a check takes from the health score.
SEVERITY_WEIGHTS = {"critical": 40, "high": 30, "medium": 20, "low": 10}
TRUE_WORDS = ("1", "true", "yes", "on", "y", "checked")
#: Ordered patterns of a post's id in a file name.
POST_ID_PATTERNS = (r"danbooru[_-](\d+)", r"__danbooru[_-](\d+)", r"^(\d{6,})(?:[_-]|$)")

"""Word lists, limits, patterns and wire names."""

# The 52 words never ranked as keywords.
STOPWORDS = [
    "a", "about", "after", "again", "all", "also", "an", "and", "are", "as",
    "at", "based", "be", "been", "between", "by", "can", "for", "from", "in",
    "into", "is", "it", "its", "learning", "method", "methods", "model",
    "models", "of", "on", "or", "our", "paper", "than", "that", "the", "their",
    "there", "these", "this", "those", "through", "to", "toward", "towards",
    "using", "we", "where", "which", "with", "without",
]

# The 27 phrases scored as a unit.
PHRASES = [
    "3d detection", "action recognition", "adversarial learning",
    "anomaly detection", "contrastive learning", "depth estimation",
    "diffusion model", "domain adaptation", "few shot", "foundation model",
    "image generation", "image segmentation", "instance segmentation",
    "language model", "medical image", "multi modal", "object detection",
    "open vocabulary", "pose estimation", "prompt learning",
    "representation learning", "scene understanding", "semantic segmentation",
    "self supervised", "video understanding", "vision language",
    "visual question answering",
]

# Scoring and id format.
PHRASE_SCORE = 4
KEYWORDS_PER_RECORD = 8
TOKEN_PATTERN = "[a-z][a-z0-9]{2,}"
ID_PREFIX = "cvpr"
SLUG_LENGTH = 80
DIGEST_LENGTH = 10

# Request defaults.
SEARCH_LIMIT = 20
KEYWORD_LIMIT = 80
RANKING_LIMIT = 20
DASHBOARD_SEARCH_LIMIT = 12
DASHBOARD_RANKING_LIMIT = 10
OVERFETCH = 5
POLL_LIMIT = 50

# Column length limits of the stored tables.
MAX_LENGTHS = {
    "source_id": 128, "title": 512, "paper_url": 1024, "pdf_url": 1024,
    "authors": 255, "institutions": 255, "keywords": 128,
}

# Fixed value: name of the change notification.
CHANGE_EVENT = "paper.updated"

# Page patterns of the listing and detail layouts.
LISTING_START = r"""(?is)<dt[^>]*class=["'][^"']*ptitle[^"']*["'][^>]*>"""
ANCHOR = r"""(?is)<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
HREF = r"""(?is)<a[^>]*href=["']([^"']+)"""
AUTHOR_INPUT = r"""(?is)<input[^>]*name=["']query_author["'][^>]*value=["']([^"']+)["'][^>]*>"""
NEXT_DD = r"(?is)</dt>\s*<dd[^>]*>(.*?)</dd>"
PDF_HREF = r"""(?is)<a[^>]*href=["']([^"']+\.pdf)["'][^>]*>"""
ABSTRACT_ELEMENT = r"""(?is)<([a-z][a-z0-9]*)\b[^>]*\bid=["']abstract["'][^>]*>(.*?)</\1>"""
ABSTRACT_OPEN = r"""(?is)<([a-z][a-z0-9]*)\b[^>]*\bid=["']abstract["'][^>]*>"""
TAG = r"(?is)<[^>]+>"
PDF_ANCHOR_WINDOW = 8

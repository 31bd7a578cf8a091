"""SQL form of keyword extraction, used only to check the Spark plans."""

from quillstream import lexicon

STOP_LIST = ", ".join(f"'{w}'" for w in lexicon.STOPWORDS)
_PHRASES = ", ".join(f"('{p}')" for p in lexicon.PHRASES)

# Unicode whitespace in RE2 terms.
WIDE_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# {{source}}, {{key}} and {{text}} name the rows, their id and the text expression.
_TEMPLATE = """norm AS (SELECT {key} AS source_id,
    regexp_replace(regexp_replace(lower({text}), '[-_/]+', ' ', 'g'), '[^a-z0-9WIDE]+', ' ', 'g') AS n FROM {source}),
    term_scores AS (SELECT source_id, phrase AS term, SCORE AS score FROM norm
        JOIN (VALUES PHRASES) AS p(phrase) ON contains(n, phrase)
        UNION ALL SELECT source_id, term, count(*) AS score FROM (
            SELECT source_id, unnest(regexp_extract_all(n, 'TOKEN')) AS term FROM norm)
        WHERE term NOT IN (STOP) GROUP BY 1, 2),
    keyword_rows AS (SELECT source_id, term, CAST(score AS BIGINT) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, term) AS rank FROM term_scores)
        WHERE rank <= LIMIT_)"""

KEYWORDS_SQL = (
    _TEMPLATE.replace("TOKEN", lexicon.TOKEN_PATTERN.replace("{", "{{").replace("}", "}}"))
    .replace("WIDE", WIDE_SPACE.replace("{", "{{").replace("}", "}}"))
    .replace("SCORE", str(lexicon.PHRASE_SCORE))
    .replace("PHRASES", _PHRASES)
    .replace("STOP", STOP_LIST)
    .replace("LIMIT_", str(lexicon.KEYWORDS_PER_RECORD))
)

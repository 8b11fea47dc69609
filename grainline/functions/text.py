"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of words.
WORD = r"[\p{L}\p{N}_]+"
# Fixed list: words that mark a query as prose.
STOPWORDS = (
    "a an the of to in on for and or is are was were be been being do does did how what why when where which who whom "
    "this that these those with without as at by from into about over under between within"
).split()


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, case kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def tokenize(text: Column) -> Column:
    return words(F.lower(text))


def alnum_tokens(text: Column) -> Column:
    """The evaluation tokenizer: as tokenize, but an underscore parts words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def searchable_text(content: Column, topics: Column, entities: Column, author: Column) -> Column:
    """Content followed by topics, entities and author, where there are any."""
    extra = F.concat_ws(" ", topics, entities, F.when(author != "", author))
    return F.when(extra == "", F.coalesce(content, F.lit(""))).otherwise(F.trim(F.concat_ws(" ", content, extra)))


def or_query(text: Column) -> Column:
    """Bare prose becomes an OR of its terms; quoted, negated or OR text stays as it is."""
    terms = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+(?:[-./][\p{L}\p{N}_]+)*"), F.lit(0))
    explicit = text.rlike(r'"') | text.rlike(r"(^|\s)-[\p{L}\p{N}_]") | text.rlike(r"(?i)\bOR\b")
    return F.when(explicit, text).otherwise(F.array_join(terms, " OR "))


def is_identifier(token: Column) -> Column:
    """Holds a digit, or is an upper-case word of two letters or more."""
    return token.rlike(r"\p{Nd}") | token.rlike(r"^\p{Lu}{2,}$")


def fusion_weights(query: Column) -> Column:
    """(dense, lexical) weights by the share of identifier-like tokens."""
    raw = words(query)
    ids, total = F.size(F.filter(raw, is_identifier)), F.size(raw)
    prose = F.exists(raw, lambda t: F.lower(t).isin(STOPWORDS))
    lexical = F.when((total > 0) & (ids * 2 >= total), 2.0).when((ids > 0) & ((total <= 3) | ~prose), 1.5).otherwise(1.0)
    return F.struct(F.lit(1.0).alias("w_dense"), lexical.alias("w_lex"))


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space, but not after one or two digits and a mark."""
    return F.split(text, r"(?<=[.!?])(?<!\d[.!?])(?<!\d\d[.!?])\s+")


def approximate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("long")


def cut_to_budget(text: Column, tokens: int, count: Column) -> Column:
    """At most 8 characters a token, then by the ratio of budget to counted tokens."""
    ceiling = F.substring(text, 1, 8 * tokens)
    ratio = F.floor(F.length(ceiling) * F.lit(tokens) / count).cast("int")
    return F.when(count <= tokens, ceiling).otherwise(F.substring(ceiling, F.lit(1), ratio))


#: Characters that aren't white space, and those of them that a text layer shouldn't have.
VISIBLE = r"[^\s\x1c-\x1f\x85\p{Z}]"
BROKEN = r"[\x{FFFD}\p{C}&&[^\s\x1c-\x1f\x85\p{Z}]]"


def native_text_status(text: Column) -> Column:
    """corrupt, sparse or usable, by replacement and control characters among the visible ones, and glyph ids."""
    visible = F.regexp_count(text, F.lit(VISIBLE))
    broken = F.regexp_count(text, F.lit(BROKEN)) >= F.greatest(F.lit(2), F.ceil(visible * 0.1))
    glyphs = F.regexp_count(text, F.lit(r"\(cid:\d+\)")) >= 2
    return F.when(broken | glyphs, "corrupt").when(visible < 20, "sparse").otherwise("usable")


def normalise_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def cache_key(model: Column, question: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, normalise_question(question)), 256)


def asks_for_collection(question: Column) -> Column:
    return question.rlike(r"(?i)\b(all|list|enumerate|how many|complete inventory)\b|\b(?:identify|name|show|give)\s+(?:me\s+)?(?:every|each)\b")


# Fixed patterns: what a request asks of several subjects.
ASKS_EACH = r"(?i)\b(for each|each of|which actions|which requirements)\b"
COMPARES = (
    r"(?i)\b(compare[sd]?|versus|vs\.?|difference(?:s)? between|relate[sd]?\s+to|relationship\s+between|both\b.*\band\b|as\s+well\s+as)\b"
)
ASKS_MORE = r"(?i)\b(also|additionally|why|compare)\b"
#: A preamble, its list up to the end of the sentence, and what follows in a new one.
LIST = r"(?s)^([^:]*):(.*?)(?:[.!?]\s+(?=[A-Z])(.*))?\z"
#: An item, with what parts it from the one before; and its words, without a bullet, a leading "and" or loose marks.
ITEM = r"(?:^|\n+|;\s*|,\s+(?:and\s+)?)((?:[^\n;,]|,(?!\s))*)"
ITEM_WORDS = r"(?s)^\s*(?:(?:[-*•]|\d+[.)])\s*|and\s+)?[ ,;]*(.*?)[\s,;]*\z"


def listed_requests(question: Column, most: int = 4) -> Column:
    """``preamble: a, b, and c`` -> one request for each of two to ``most`` items, else empty.

    A second sentence that asks for more makes the list incomplete, so none is given.
    """
    preamble, listed, after = (F.regexp_extract(question, LIST, n) for n in (1, 2, 3))
    items = F.transform(F.regexp_extract_all(listed, F.lit(ITEM), F.lit(1)), lambda x: F.regexp_extract(x, ITEM_WORDS, 1))
    items = F.filter(items, lambda x: x != "")
    requests = F.transform(items, lambda x: F.concat_ws(": ", F.trim(preamble), x))
    return F.when(F.size(items).between(2, most) & ~after.rlike(ASKS_MORE), requests).otherwise(F.array().cast("array<string>"))


def looks_multi_part(question: Column) -> Column:
    """Whether one search may not answer it: several questions, a list, or a word that asks of several subjects."""
    several = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit(""))) >= 2
    return F.coalesce(several | question.rlike(ASKS_EACH) | question.rlike(COMPARES) | (F.size(listed_requests(question)) > 0), F.lit(False))


def byte_range(header: Column, size: Column) -> Column:
    """``bytes=a-b``, ``bytes=a-`` and ``bytes=-n`` as inclusive bounds; null if unsatisfiable."""
    first = F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.lit("")).cast("long")
    last = F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2), F.lit("")).cast("long")
    low = F.when(first.isNull(), F.greatest(F.lit(0).cast("long"), size - last)).otherwise(first)
    high = F.when(first.isNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    valid = (first.isNotNull() | (last > 0)) & (low <= high) & (low < size)
    return F.when(valid, F.struct(low.alias("first"), high.alias("last")))


def is_object_id(value: Column) -> Column:
    return value.rlike(r"^[0-9a-fA-F]{24}$")


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^\s{0,3}(#{1,6})\s+\S", 1))


def is_markdown_table(text: Column) -> Column:
    body = F.trim(F.coalesce(text, F.lit("")))
    return body.startswith("|") & body.contains("\n") & body.rlike(r"\|\s*:?-{3,}")


def chunk_id(doc: Column, ordinal: Column, total: Column) -> Column:
    """Document id and the 1-based ordinal, padded to the digits of the total, three at least."""
    width = F.greatest(F.lit(3), F.length(total.cast("string")))
    number = (ordinal + 1).cast("string")
    return F.concat(doc.cast("string"), F.repeat(F.lit("0"), width - F.length(number)), number)


def backoff_seconds(attempt: Column, ceiling: int = 60) -> Column:
    return F.when(attempt < 1, F.lit(0.0)).otherwise(F.least(F.lit(float(ceiling)), F.pow(F.lit(2.0), F.least(attempt, F.lit(30)))))


def markdown_row(cells: Column) -> Column:
    clean = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"[\r\n]", " ")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def rows_to_markdown(rows: Column) -> Column:
    """An array of rows, the first of them the header, as a pipe table; short rows are padded."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(padded, markdown_row)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when((F.size(rows) > 0) & (width > 0), F.array_join(body, "\n")).otherwise("")

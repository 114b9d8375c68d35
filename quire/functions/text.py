"""Title, word and display functions as Column expressions (they stay in generated code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quire.schemas import STOP_WORDS, TITLE_KEY_BYTES, WORD_KEY_CHARS

#: Characters folded to "-": U+2010 to U+2015, U+2212, U+2043, U+FE58, U+FE63, U+FF0D.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
#: White space as the index builder's str.split sees it.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
WHITE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_title(title: Column | str) -> Column:
    """Dashes folded, lower case, white space collapsed and trimmed."""
    folded = F.lower(F.translate(_c(title), DASHES, "-" * len(DASHES)))
    return F.trim(F.regexp_replace(folded, WHITE + "+", " "))


def device_key(query: Column | str) -> Column:
    """A query as the device folds it: trimmed, ASCII lower case only."""
    trimmed = F.regexp_replace(_c(query), r"^[\t-\r ]+|[\t-\r ]+$", "")
    return F.translate(trimmed, _ASCII_UPPER, _ASCII_LOWER)


def title_or_path(title: Column | str, path: Column | str, decode: bool = True) -> Column:
    """The title, or the path behind its first "/" with "_" as blanks, percent-decoded if decode ("+" stays)."""
    tail = F.regexp_replace(_c(path), r"^[^/]*/", "")
    if decode:
        plain = F.replace(tail, F.lit("+"), F.lit("%2B"))
        tail = F.coalesce(F.try_url_decode(plain), tail)
    return F.coalesce(F.nullif(_c(title), F.lit("")), F.replace(tail, F.lit("_"), F.lit(" ")))


def cut_bytes(x: Column | str, n: int) -> Column:
    """The first n bytes of the UTF-8 form, as binary."""
    return F.substring(_c(x).cast("binary"), 1, n)


def title_key(title: Column | str, n: int = TITLE_KEY_BYTES) -> Column:
    """Key of n bytes at most: cut, a broken last character replaced by U+FFFD, and cut again (binary)."""
    return cut_bytes(F.make_valid_utf8(cut_bytes(title, n).cast("string")), n)


def key_text(key: Column | str) -> Column:
    """A key's bytes as text; a broken last character gives U+FFFD."""
    return F.make_valid_utf8(_c(key).cast("string"))


def padded(key: Column, n: int) -> Column:
    """Binary of n bytes, cut or padded with NUL."""
    return F.substring(F.concat(key, F.lit(b"\0" * n)), 1, n)


def title_words(title: Column | str) -> Column:
    """Cleaned words of a title: letters, digits and inner dashes; of three characters or more, no stop words, cut to 13."""
    raw = F.split(F.trim(F.regexp_replace(_c(title), WHITE + "+", " ")), " ")
    clean = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, r"[^\p{L}\p{N}-]", ""), "^-+|-+$", ""))
    good = F.filter(clean, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(good, lambda w: F.substring(w, 1, WORD_KEY_CHARS)))


def query_word(query: Column | str) -> Column:
    """The word that a query is looked up by: the longest of three bytes or more, the first of equals; lengths count up to 13, so
    of longer words the last wins. Null if there is none."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("size"))

    def step(best: Column, word: Column) -> Column:
        size = F.octet_length(word)
        wins = (size >= 3) & (size > best["size"])
        return F.struct(
            F.when(wins, word).otherwise(best["word"]).alias("word"),
            F.when(wins, F.least(size, F.lit(WORD_KEY_CHARS))).otherwise(best["size"]).alias("size"),
        )

    best = F.aggregate(F.split(_c(query), " "), start, step)
    return F.when(best["size"] > 0, F.substring(best["word"], 1, WORD_KEY_CHARS))


#: Language names by code; fixed values.
LANGUAGES = {
    "en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese",
    "nl": "Dutch", "pl": "Polish", "ru": "Russian", "ja": "Japanese", "zh": "Chinese", "ar": "Arabic",
}
VARIANTS = ("simple", "nopic")


def _capitalised(word: Column) -> Column:
    return F.initcap(word)


def display_name(path: Column | str) -> Column:
    """An archive's file name as a readable name, such as "Simple English: All Maxi May 2026"."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(path), r"^.*/", ""), r"(?i)\.zim$", ""), "^wikipedia_", "")
    parts = F.split(stem, "_")
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    language = F.coalesce(names[first], _capitalised(first))
    varied = F.coalesce(F.lower(second).isin(*VARIANTS), F.lit(False))
    head = F.when(varied, F.concat(_capitalised(second), F.lit(" "), language)).otherwise(language)
    rest = F.slice(parts, F.when(varied, 3).otherwise(2), F.greatest(F.size(parts), F.lit(1)))
    month = lambda p: F.date_format(F.try_to_timestamp(p, F.lit("yyyy-MM")), "MMMM yyyy")
    shown = F.transform(rest, lambda p: F.when(p.rlike(r"^\d{4}-\d{2}$"), F.coalesce(month(p), p)).otherwise(_capitalised(p)))
    return F.when(F.size(rest) > 0, F.concat(head, F.lit(": "), F.array_join(shown, " "))).otherwise(head)


def name_lines(name: Column | str) -> Column:
    """A display name in up to three lines: before ": ", the rest but its last two words, and those."""
    head = F.substring_index(_c(name), ": ", 1)
    tail = F.when(F.instr(_c(name), ": ") > 0, F.substring(_c(name), F.length(head) + 3, 1 << 20)).otherwise("")
    words = F.split(tail, " ")
    last = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ")
    early = F.when(F.size(words) > 2, F.array_join(F.slice(words, 1, F.size(words) - 2), " ")).otherwise("")
    return F.filter(F.array(head, early, last), lambda x: x != "")


def is_internal_link(href: Column | str) -> Column:
    """Whether a link's target is an entry of the catalog; null counts as none."""
    h = _c(href)
    outside = reduce(lambda a, b: a | b, [h.startswith(p) for p in ("#", "http", "./", "../")]) | h.contains("://")
    return F.coalesce((h != "") & ~outside, F.lit(False))


def link_target(href: Column | str) -> Column:
    """The normalised title that a link points to."""
    return normalise_title(F.replace(F.substring_index(_c(href), "#", 1), F.lit("_"), F.lit(" ")))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-cased extension, empty without a dot."""
    p = _c(path)
    return F.when(p.contains("."), F.lower(F.substring_index(p, ".", -1))).otherwise("")


def image_candidates(src: Column | str) -> Column:
    """Keys under which an image may be known, in order of precedence."""
    plain = F.regexp_replace(_c(src), r"^(?:\.\.?/)+", "")
    base = base_name(plain)
    return F.array(_c(src), plain, F.concat(F.lit("I/"), base), F.concat(F.lit("A/I/"), base), base)


def html_escape(text: Column | str) -> Column:
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def viewer_links(html: Column | str) -> Column:
    """Links to entries rewritten to calls of a viewer's function."""
    return F.regexp_replace(_c(html), r'href="/wiki/(\d+)"', r'href="#" onclick="loadArticle($1);return false;"')


def result_row(title: Column | str) -> Column:
    """A title as a result row shows it."""
    return F.substring(_c(title), 1, 36)


def query_line(text: Column | str) -> Column:
    """What the input line shows of a query."""
    return F.substring(_c(text), 1, 34)


def page_title(title: Column | str, page: Column | str) -> Column:
    """A paged entry's title: 18 characters and the page number, from 1."""
    return F.concat(F.substring(_c(title), 1, 18), F.lit(" p."), (_c(page) + 1).cast("string"))


def api_article_id(url: Column | str) -> Column:
    """The entry number of an /api/article/N path; null for what is none (a bad request)."""
    digits = F.regexp_extract(F.parse_url(_c(url), F.lit("PATH")), r"^/api/article/([+-]?\d{1,18})$", 1)
    return F.nullif(digits, F.lit("")).try_cast("long")


def api_query(url: Column | str, name: str = "q") -> Column:
    """A parameter of a URL's query, decoded."""
    return F.coalesce(F.try_url_decode(F.parse_url(_c(url), F.lit("QUERY"), F.lit(name))), F.lit(""))


def decode_entities(text: Column | str) -> Column:
    """Entities in one pass: amp lt gt quot apos nbsp and numbers; numbers outside 32..127 give a blank; a ";" must follow within
    nine characters; others stay as they are."""
    pieces = F.regexp_extract_all(_c(text), F.lit(r"(?s)&(?:amp|lt|gt|quot|apos|nbsp|#[^;]{0,7});|[^&]+|&"), F.lit(0))
    named = F.create_map(*[F.lit(x) for kv in {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}.items() for x in kv])

    def one(p: Column) -> Column:
        body = F.substring(p, F.lit(2), F.length(p) - 2)
        hexa = F.regexp_extract(body, r"^#[xX]\s*([+-]?(?:0[xX])?[0-9A-Fa-f]*)", 1)
        hexa = F.regexp_replace(F.regexp_replace(hexa, r"^\+", ""), r"^(-?)0[xX]", "$1")
        deci = F.regexp_extract(body, r"^#\s*([+-]?\d*)", 1)
        code = F.when(body.rlike("^#[xX]"), F.when(hexa.startswith("-"), F.lit(-1)).otherwise(F.conv(F.coalesce(F.nullif(hexa, F.lit("")), F.lit("0")), 16, 10).try_cast("long"))).otherwise(F.coalesce(deci.try_cast("long"), F.lit(0)))
        number = F.when((code >= 32) & (code < 128), F.char(code)).otherwise(" ")
        known = F.when(body.startswith("#"), number).otherwise(F.coalesce(named[body], p))
        return F.when((F.length(p) >= 2) & p.startswith("&") & p.endswith(";"), known).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")

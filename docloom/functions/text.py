"""Column functions on prose, slugs, paths and codes; all stay inside the JVM.

Offsets count characters. Regular expressions carry (?U) where letters beyond ASCII count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Auxiliaries of passive voice, weasel words, reading-ease bands.
AUXILIARIES = ("was ", "were ", "is ", "are ", "been ", "be ")
WEASEL_WORDS = ("clearly", "obviously", "basically", "simply", "just", "actually", "really", "very", "quite", "perhaps", "maybe", "possibly")
GRADES = ((90, "5th grade"), (80, "6th grade"), (70, "7th grade"), (60, "8th-9th grade"), (50, "10th-12th grade"), (30, "College"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words between white space, counted without being cut out."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def syllables(text: Column) -> Column:
    """Vowel groups of each word, one at least: all vowel groups of the text, and the words
    that have none; white space parts vowel groups as it parts words."""
    return F.regexp_count(F.lower(text), F.lit("[aeiouy]+")) + F.regexp_count(F.lower(text), F.lit(r"(?U)(?<!\S)[^\saeiouy]+(?!\S)"))


def readability(text: Column) -> Column:
    """Flesch reading ease between 0 and 100; 100 for a text without words."""
    return reading_ease(word_count(text), F.regexp_count(text, F.lit("[.!?]")), syllables(text))


def reading_ease(n_words: Column, stops: Column, n_syllables: Column) -> Column:
    """The score from what is counted once: words, ends of sentences, syllables."""
    n = n_words.cast("double")
    score = F.lit(206.835) - 1.015 * n / F.greatest(F.lit(1), stops) - 84.6 * n_syllables / n
    return F.when(n <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def prose_counts(text: Column) -> Column:
    """words, stops and syllables of a text as a struct, so that plans count each once."""
    return F.struct(word_count(text).alias("words"), F.regexp_count(text, F.lit("[.!?]")).alias("stops"), syllables(text).alias("syllables"))


def grade(score: Column) -> Column:
    out = F.lit("College graduate")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def passive_hits(line: Column) -> Column:
    """Array of passive verbs, in order: an auxiliary (also inside a word) and a token over three
    letters long in -ed that white space other than a line break, a full stop or a comma ends.
    No auxiliary begins within another, so one pattern finds those of all."""
    any_of = "|".join(AUXILIARIES)
    return F.filter(F.regexp_extract_all(F.lower(line), F.lit(rf"(?:{any_of})(?=([^\s.,]*ed)(?!\r?\n)[\s.,])"), F.lit(1)), lambda t: F.length(t) > 3)


def weasel_hits(line: Column, words: tuple[str, ...] = WEASEL_WORDS) -> Column:
    """Array of the whole words of a list that a line holds, in order and lower-cased, whatever
    the case. One pattern for all words, the longest first."""
    any_of = "|".join(_literal(w.lower()) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.lower(line), F.lit(rf"(?<![\p{{L}}\p{{N}}])({any_of})(?![\p{{L}}\p{{N}}])"), F.lit(1))


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def heading_slug(text: Column) -> Column:
    """A heading as an anchor: without its number, ASCII letters in lower case, each run of
    what is neither letter nor digit as one dash."""
    bare = F.trim(F.regexp_replace(text, r"^[0-9.]+", ""))
    return _strip_dashes(F.regexp_replace(F.translate(bare, UPPER, UPPER.lower()), r"[^\p{L}\p{N}]+", "-"))


def text_slug(text: Column) -> Column:
    """Text as an anchor: ASCII letters and digits, blanks, dashes and underscores as one
    dash, others dropped; null if nothing is left."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s_-]", "")
    out = _strip_dashes(F.regexp_replace(kept, r"[\s_-]+", "-"))
    return F.nullif(out, F.lit(""))


def title_id(text: Column) -> Column:
    """A title as an id: letters and digits of any script, other runs as one dash."""
    return _strip_dashes(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"))


def _strip_dashes(c: Column) -> Column:
    return F.regexp_replace(c, r"^-+|-+$", "")


def bookmark_class(name: Column) -> Column:
    return F.when(name.startswith("_Toc"), "toc").when(name.startswith("_Ref"), "reference").when(name.startswith("_Hlk"), "highlight").when(name.startswith("_"), "internal").otherwise("user")


def without_parentheses(text: Column) -> Column:
    """Text without parenthesised parts (nested to any depth; one left open runs to the end),
    stray closing ones, and with single blanks. Two passes take what nests up to two deep;
    the rest is folded over its brackets and what stands between them."""
    for _ in range(2):
        text = F.regexp_replace(text, r"\([^()]*\)", "")
    step = lambda a, t: (
        F.when(t == "(", F.struct((a["open"] + 1).alias("open"), a["out"].alias("out")))
        .when(t == ")", F.struct(F.greatest(F.lit(0), a["open"] - 1).alias("open"), a["out"].alias("out")))
        .otherwise(F.struct(a["open"].alias("open"), F.when(a["open"] == 0, F.concat(a["out"], t)).otherwise(a["out"]).alias("out")))
    )
    folded = F.aggregate(F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0)), F.struct(F.lit(0).alias("open"), F.lit("").alias("out")), step, lambda a: a["out"])
    text = F.when(text.contains("(") | text.contains(")"), folded).otherwise(text)
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slide_text(text: Column, most: int = 80) -> Column:
    """At most `most` characters, cut behind the last whole word with an ellipsis."""
    bare = without_parentheses(text)
    cut = F.substring(bare, 1, most)
    whole = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(whole, F.lit("...")))


def needs_notes(kind: Column, text: Column, bullets: Column) -> Column:
    return F.when(kind == "paragraph", F.length(text) > 200).when(kind == "list", bullets > 5).otherwise(False)


def speaker_notes(kind: Column, text: Column, items: Column) -> Column:
    """The whole paragraph beyond 80 characters, or the items beyond the third."""
    rest = F.array_join(F.slice(items, 4, F.greatest(F.lit(1), F.size(items))), "\n")
    long = F.concat(F.lit("Key points: "), text)
    return F.when((kind == "paragraph") & (F.length(text) > 80), long).when((kind == "list") & (F.size(items) > 3), F.concat(F.lit("Additional points not shown:\n"), rest))


def id_list(value: Column) -> Column:
    """Comma-separated ids, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def content_hash(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.sha2(text, 256))


def column_index(letters: Column) -> Column:
    """A spreadsheet column's 0-based index: A is 0, AA is 26."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def column_letters(index: Column) -> Column:
    """The inverse of column_index, for up to six letters."""
    out, left = F.lit(""), index.cast("bigint") + 1
    for _ in range(6):
        digit = F.pmod(left - 1, F.lit(26))
        out = F.when(left > 0, F.concat(F.char(digit + 65), out)).otherwise(out)
        left = F.when(left > 0, F.floor((left - 1) / 26)).otherwise(F.lit(0))
    return out


def serial_to_iso(serial: Column) -> Column:
    """A spreadsheet serial (1900 system, with its leap day that never was) as ISO text, with
    the time where the fraction counts; null below 1."""
    day = F.floor(serial).cast("int")
    date = F.when(day >= 60, F.date_add(F.lit("1899-12-30").cast("date"), day)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), day))
    fraction = serial - F.floor(serial)
    seconds = F.round(fraction * 86400).cast("int")
    clock = F.format_string("T%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.pmod(F.floor(seconds / 60).cast("int"), F.lit(60)), F.pmod(seconds, F.lit(60)))
    iso = F.date_format(date, "yyyy-MM-dd")
    return F.when(serial >= 1, F.when(fraction > 1e-4, F.concat(iso, clock)).otherwise(iso))


def like_serial_date(value: Column) -> Column:
    return value.between(1.0, 55000.0) & (F.pmod(value, F.lit(1.0)) < 1e-4)


EMU = {"px": 9525.0, "in": 914400.0, "pt": 12700.0, "cm": 360000.0}


def from_emu(emu: Column, unit: str) -> Column:
    return F.round(emu / EMU[unit], 4)


def escape_json(c: Column) -> Column:
    return _replaced(c, (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")))


def escape_html(c: Column) -> Column:
    return _replaced(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def escape_xml(c: Column) -> Column:
    return _replaced(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def escape_typst(c: Column) -> Column:
    return _replaced(c, (("\\", "\\\\"), ('"', '\\"')))


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def expanded(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {name} places filled; null values leave nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def normal_path(base_uri: Column, relative: Column) -> Column:
    """The URI that a relative reference in a document means: `.` and `..` folded against the
    document's directory; an absolute path keeps scheme and host."""
    root = F.regexp_extract(base_uri, r"^([a-z]+://[^/]*)", 1)
    path = F.substring(base_uri, F.length(root) + 1, F.length(base_uri))
    joined = F.when(relative.startswith("/"), relative).otherwise(F.concat(F.regexp_replace(path, r"/[^/]*$", ""), F.lit("/"), relative))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(p))))
    return F.concat(root, F.lit("/"), F.array_join(fold, "/"))


def offset_line(text: Column, offset: Column) -> Column:
    """The 0-based line that holds a character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n")) - 1


def offset_column(text: Column, offset: Column) -> Column:
    return F.length(F.element_at(F.split(F.substring(text, F.lit(1), offset), "\n"), -1))


def days_to_date(days: Column) -> Column:
    """The date so many days after 1970-01-01."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def utc_stamp(seconds: Column) -> Column:
    """Seconds since 1970 as ISO 8601 text in UTC, whatever the session's time zone; years beyond
    9999 carry no sign."""
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400)).cast("int")
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600).cast("int"), F.pmod(F.floor(rest / 60).cast("int"), F.lit(60)), F.pmod(rest, F.lit(60)))
    return F.concat(F.ltrim(F.date_format(days_to_date(day), "yyyy-MM-dd"), F.lit("+")), clock)

"""Scalar functions as column expressions: times, frame rates, text, sizes. Times are whole milliseconds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Korean particles (longest first) and verb endings.
PARTICLES = (
    "에서는", "으로는", "이라고", "에게서", "한테서", "에서", "으로", "이랑", "처럼", "부터", "까지", "마다", "보다",
    "한테", "에게", "께서", "이나", "밖에", "조차", "라도", "이란", "라는",
    "을", "를", "이", "가", "은", "는", "의", "에", "와", "과", "로", "도", "만", "랑",
)
VERB_ENDINGS = (
    "하라고", "라고", "는데", "는지", "야지", "니야", "었어", "았어", "겠어", "드라", "더라", "네요", "군요", "잖아",
    "거야", "해서", "니까", "면서", "지만", "구나", "습니다", "입니다", "합니다", "세요", "어요", "아요",
)
# Characters that file names reserve, longest slug, units of sizes.
RESERVED = '%\\/:*?"<>|#[]^\n'
SLUG_MAX = 80
UNITS = "BKMGT"
# Frame rates with their exact fractions.
NTSC = ((23.976, 24000, 1001), (29.97, 30000, 1001), (59.94, 60000, 1001))


def div(a, b) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.call_function("div", a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))


def half_even(a: Column, b) -> Column:
    """a / b rounded half to even, without floating point."""
    q = div(a, b)
    twice = (a - q * b) * 2
    return q + F.when((twice > b) | ((twice == b) & (q % 2 == 1)), 1).otherwise(0)


def frames(ms: Column, num: int, den: int) -> Column:
    """Index of the frame at an instant, by the exact rate num/den."""
    return half_even(ms * num, F.lit(1000 * den).cast("long"))


def nominal(num: int, den: int) -> int:
    return max(1, round(num / den))


def timecode(ms: Column, num: int, den: int) -> Column:
    """Hh:mm:ss:ff, non-drop; frames counted exactly, shown on the nominal base."""
    f, base = frames(ms, num, den), nominal(num, den)
    s = div(f, base)
    return F.format_string("%02d:%02d:%02d:%02d", div(s, 3600), div(s, 60) % 60, s % 60, f % base)


def rational(ms: Column, num: int, den: int) -> Column:
    """Frame-aligned rational seconds, a whole multiple of den/num."""
    return F.concat((frames(ms, num, den) * den).cast("string"), F.lit(f"/{num}s"))


def frame_rate(exact: Column, fps: Column) -> Column:
    """struct(num, den) from "num/den" text, reduced; else of the known rate within 0.005; else whole."""
    part = [F.coalesce(F.regexp_extract(exact, r"^\s*(\d{1,15})\s*/\s*(\d{1,15})\s*$", k).try_cast("long"), F.lit(0).cast("long")) for k in (1, 2)]
    # Euclid: 80 steps are enough for numbers of fifteen digits
    g = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(part[0].alias("a"), part[1].alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.nullif(s["b"], F.lit(0).cast("long"))).alias("b"))), lambda s: s["a"])
    pair = lambda n, d: F.struct(F.lit(n).cast("long").alias("num"), F.lit(d).cast("long").alias("den"))
    known = F.when(F.lit(False), pair(1, 1))
    for rate, n, d in NTSC:
        known = known.when(F.abs(fps - rate) < 0.005, pair(n, d))
    whole = F.struct(F.greatest(F.lit(1), F.bround(fps, 0)).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    return F.when((part[0] > 0) & (part[1] > 0), F.struct(div(part[0], g).alias("num"), div(part[1], g).alias("den"))).otherwise(known.otherwise(whole))


def clock(ms: Column, mark: str = ".") -> Column:
    """HH:MM:SS.mmm; with a comma, the time of a subtitle."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000)


def clock_compact(ms: Column) -> Column:
    """MM:SS.mmm below an hour, else H:MM:SS.mmm."""
    hours = div(ms, 3_600_000)
    rest = F.format_string("%02d:%02d.%03d", div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000)
    return F.when(hours == 0, rest).otherwise(F.concat(hours.cast("string"), F.lit(":"), rest))


def clock_label(ms: Column) -> Column:
    """The compact form without .000."""
    return F.regexp_replace(clock_compact(ms), r"\.000$", "")


def frame_name(ms: Column) -> Column:
    return F.format_string("t%09d.jpg", ms)


def parse_clock(text: Column) -> Column:
    """Milliseconds of "12.5", "1:23.5" or "01:02:03.25"; null for anything else and for negative parts."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(F.trim(p).rlike(r"^\+?(\d+\.?\d*|\.\d+)$"), F.trim(p).try_cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(F.size(parts) <= 3, F.bround(total * 1000, 0).cast("long"))


def stem(token: Column) -> Column:
    """One trailing particle off, the longest first, if two characters stay."""
    out = F.when(F.lit(False), token)
    for p in PARTICLES:
        out = out.when(F.endswith(token, F.lit(p)) & (F.length(token) >= len(p) + 2), F.left(token, F.length(token) - len(p)))
    return out.otherwise(token)


def verb_form(token: Column) -> Column:
    """Whether a token ends as an inflected verb."""
    return token.rlike(f"({'|'.join(VERB_ENDINGS)})$")


def new_terms(asr: Column, corrected: Column) -> Column:
    """J05 with J03 and J04: stems of the corrected text that the transcript lacks; none for annotations in brackets."""
    stems = lambda c: F.transform(F.filter(F.split(c, r"\s+"), lambda x: x != ""), stem)
    word = lambda t: (F.length(t) >= 2) & t.rlike("^[0-9A-Za-z가-힣]+$") & ~verb_form(t)
    found = F.array_except(F.filter(stems(corrected), word), stems(asr))
    return F.when(F.ltrim(corrected).startswith("("), F.array().cast("array<string>")).otherwise(found)


def slug(label: Column) -> Column:
    """Every reserved character by its own %HH, so that labels stay apart; beyond 80 characters cut, with a digest."""
    out = label
    for c in RESERVED:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    out = F.btrim(out)
    long = F.concat(F.left(out, F.lit(SLUG_MAX - 9)), F.lit("-"), F.left(F.sha2(label, 256), F.lit(8)))
    return F.when(out == "", "_").when(F.length(out) > SLUG_MAX, long).otherwise(out)


def reason_slug(reason: Column) -> Column:
    """A file name's ending from a reason (in NFC already)."""
    s = F.btrim(F.regexp_replace(reason, "[^0-9A-Za-z가-힣-]+", "-"), F.lit("-"))
    return F.when(F.coalesce(s, F.lit("")) == "", "").otherwise(F.concat(F.lit("-"), F.rtrim(F.left(s, F.lit(40)), F.lit("-"))))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit below 1024 of it, one decimal."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for k, unit in enumerate(UNITS[1:], 1):
        tenths = half_even(n * 10, F.lit(1024**k).cast("long"))
        text = F.concat(div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))
        out = out.otherwise(text) if k == len(UNITS) - 1 else out.when(n < 1024 ** (k + 1), text)
    return out


def modality(level: Column) -> Column:
    """What the evidence of a step is; unknown levels count as estimates."""
    return F.when(level.isin("visual_only", "cross_modal"), "visual_verified").when(level == "transcript_only", "speech_only").otherwise("agent_estimated")


def uncertain(conf: Column, logprob: Column, no_speech: Column) -> Column:
    """By confidence where there is one, else by log probability or silence."""
    return F.when(conf.isNotNull(), conf < 0.6).otherwise(F.coalesce(logprob < -1.0, F.lit(False)) | F.coalesce(no_speech > 0.5, F.lit(False)))


def shot_scale(boxes: Column) -> Column:
    """By the largest face (x, y, w, h in shares); null without a face."""
    area = F.array_max(F.transform(boxes, lambda b: F.get(b, 2) * F.get(b, 3)))
    return F.when(area >= 0.05, "close").when(area >= 0.008, "medium").when(area.isNotNull(), "long")


def roi(text: Column) -> Column:
    """struct(x, y, w, h) of "x,y,w,h" with positive extent, else null."""
    p = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    ok = (F.size(p) == 4) & (F.get(p, 0) >= 0) & (F.get(p, 1) >= 0) & (F.get(p, 2) > 0) & (F.get(p, 3) > 0)
    return F.when(ok, F.struct(*(F.get(p, k).alias(c) for k, c in enumerate("xywh"))))


def escaped(text: Column, quotes: bool = False) -> Column:
    """Text for XML; with quotes, as an attribute in double quotes."""
    for a, b in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")) + ((('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")) if quotes else ()):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"')) if quotes else text


def single_line(text: Column) -> Column:
    """One line, characters that XML 1.0 lacks replaced, no comment mark."""
    clean = F.regexp_replace(text, "[^\\x{09}\\x{0A}\\x{0D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "�")
    lines = F.regexp_replace(F.regexp_replace(clean, "(\\r\\n|[\\n\\r\\x{85}\\x{2028}\\x{2029}])$", ""), "\\r\\n|[\\n\\r\\x{85}\\x{2028}\\x{2029}]", " ")
    return F.replace(lines, F.lit("* COMMENT:"), F.lit("COMMENT:"))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """J01; Spark has no normalization."""
    return text.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFC and full case folding, which lower() isn't."""
    return text.str.normalize("NFC").str.casefold()


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null where it doesn't parse. Hash it with sha2."""

    def one(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def tag(text: Column) -> Column:
    """A tag without white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "-")


def ellipsized(text: Column, most: int = 40) -> Column:
    """At most so many characters, cut behind a word if that leaves more than half, with an ellipsis."""
    cut = F.substring(text, F.lit(1), F.lit(most))
    space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1  # characters before the last space, -1 without
    told = F.when(space > most // 2, F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(told, F.lit(" ,·—-(")), F.lit("…")))


#: What a file's stem must not hold, and how long it may be in characters and in bytes.
UNSAFE_STEM = r'[/\\:*?"<>|\[\]#^\x00-\x1f]+'
STEM_CHARS, STEM_BYTES = 80, 245


def doc_stem(title: Column) -> Column:
    """A stem from a title, '' for null: no unsafe characters, no outer spaces or points, cut behind a word if that leaves
    half of what fits."""
    s = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), UNSAFE_STEM, " "), r"(?U)\s+", " "), F.lit(" ."))

    def behind_word(cut):
        head = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
        return F.btrim(F.when((head >= 0) & (head >= F.floor(F.length(cut) / 2)), F.substring(cut, F.lit(1), head)).otherwise(cut))

    def bounded(v):
        fits = F.filter(F.sequence(F.lit(0), F.lit(STEM_CHARS)), lambda n: F.octet_length(F.substring(v, F.lit(1), n)) <= STEM_BYTES)
        return F.when((F.length(v) <= STEM_CHARS) & (F.octet_length(v) <= STEM_BYTES), v).otherwise(_once(F.substring(v, F.lit(1), F.array_max(fits)), behind_word))

    return _once(s, bounded)


def _once(value: Column, f) -> Column:
    """f(value), where value is computed once for a row however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def code_span(text: Column) -> Column:
    """A Markdown code span whose fence is longer than any run of back-ticks within."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)")), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, text, pad, fence)


#: Characters of a diagram's label and how they are written, the ampersand first.
LABEL_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\\", "&#92;"), ("[", "&#91;"), ("]", "&#93;"), ("|", "&#124;"), ("`", "&#96;"), ("\n", "&#10;")]


def diagram_label(text: Column) -> Column:
    """Text within a quoted label of a diagram; line ends of any kind are one character."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for a, b in LABEL_ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_folder(url: Column) -> Column:
    """The folder of media fetched from an address."""
    return F.concat(F.lit("url-"), F.substring(F.md5(url), 1, 8))

"""Decision rules over scores, labels and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the content-type policy.
BLOCK_BYTES, FEATURE_BYTES, PADDING, LEAST_BYTES, MEDIUM = 4096, 1024, 256, 8, 0.5
LABEL_THRESHOLDS = {
    "crt": 0.9, "handlebars": 0.9, "ignorefile": 0.95, "latex": 0.95, "markdown": 0.75, "ocaml": 0.9,
    "pascal": 0.95, "r": 0.9, "rst": 0.9, "sql": 0.9, "tsv": 0.9, "zig": 0.9,
}
OVERWRITE = {"randombytes": "unknown", "randomtxt": "txt"}
MODES = ("BEST_GUESS", "HIGH_CONFIDENCE", "MEDIUM_CONFIDENCE")


def _map(d: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def score_band(score: Column, high: float = 0.6, low: float = 0.1) -> Column:
    """``high``, ``low`` or null for scores under both thresholds."""
    return F.when(score >= high, F.lit("high")).when(score >= low, F.lit("low"))


def liveness(p: Column, threshold: float = 0.85) -> Column:
    """STRUCT<score, live, attack> of probabilities [print, live, replay]."""
    live = p[1] > F.lit(threshold).cast("float")
    attack = F.when(live, F.lit(None).cast("string")).when(p[0] >= p[2], F.lit("print")).otherwise(F.lit("replay"))
    return F.struct(p[1].alias("score"), live.alias("live"), attack.alias("attack"))


def orientation(p: Column, threshold: float = 0.5) -> Column:
    """STRUCT<degrees, score>: ties and unsure flips are upright."""
    flip = (p[1] > p[0]) & (p[1] >= F.lit(threshold).cast("float"))
    return F.struct(F.when(flip, F.lit(180)).otherwise(F.lit(0)).alias("degrees"), F.when(flip, p[1]).otherwise(p[0]).alias("score"))


def verified(similarity: Column, threshold: Column | None = None, default: float = 0.35) -> Column:
    t = F.lit(default).cast("float") if threshold is None else F.coalesce(threshold, F.lit(default)).cast("float")
    return similarity >= t


def plate_type(code: Column, colour: Column, layer: Column) -> Column:
    """Type of a plate by its text, else by colour class (``yellow``, ``blue``, ``green``) and rows."""
    by_colour = F.when(colour == "yellow", F.when(layer == 1, F.lit("YELLOW_DOUBLE")).otherwise(F.lit("YELLOW_SINGLE"))).when(colour == "blue", F.lit("BLUE")).when(colour == "green", F.lit("GREEN")).otherwise(F.lit("UNKNOWN"))
    return (
        F.when(code.isNull() | (code == ""), by_colour)
        .when(code.startswith("WJ"), F.lit("WHITE_POLICE"))
        .when(F.length(code) == 8, F.lit("GREEN"))
        .when(code.contains("学"), F.lit("BLUE"))
        .when(code.contains("港") | code.contains("澳"), F.lit("HONG_KONG_MACAO"))
        .when(code.contains("警"), F.lit("WHITE_POLICE"))
        .when(code.startswith("粤Z"), F.lit("HONG_KONG_MACAO"))
        .otherwise(by_colour)
    )


def resolve_label(label: Column, score: Column, is_text: Column, mode: str = "HIGH_CONFIDENCE", thresholds: dict[str, float] | None = None, overwrite: dict[str, str] | None = None) -> Column:
    """Output label of a content-type guess; under its threshold it is ``txt`` or ``unknown``.

    The threshold is that of the guessed label; ``is_text`` tells of the
    overwritten one.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    out = overwritten(label, overwrite)
    if mode == "BEST_GUESS":
        return out
    limit = F.lit(MEDIUM).cast("float")
    if mode == "HIGH_CONFIDENCE":
        t = LABEL_THRESHOLDS if thresholds is None else thresholds
        if t:
            limit = F.coalesce(F.element_at(_map(t), label).cast("float"), limit)
    return F.when(score >= limit, out).when(is_text, F.lit("txt")).otherwise(F.lit("unknown"))


def overwritten(label: Column, overwrite: dict[str, str] | None = None) -> Column:
    o = OVERWRITE if overwrite is None else overwrite
    return F.coalesce(F.element_at(_map(o), label), label) if o else label


def few_bytes_label(content: Column) -> Column:
    """``empty``, ``txt`` or ``unknown`` where a model is not asked; null where it is.

    Contents under 8 bytes, and those of under 8 bytes after leading white
    space, are text if valid UTF-8.
    """
    head = F.substring(content, 1, BLOCK_BYTES)
    text = F.when(F.is_valid_utf8(head.cast("string")), F.lit("txt")).otherwise(F.lit("unknown"))
    rest = F.octet_length(head) - strip_left(head)
    return F.when(F.octet_length(content) == 0, F.lit("empty")).when((F.octet_length(content) < LEAST_BYTES) | (rest < LEAST_BYTES), text)


def strip_left(content: Column) -> Column:
    """Number of leading ASCII white space bytes (09-0D, 20)."""
    h = F.hex(content)
    return ((F.length(h) - F.length(F.regexp_replace(h, "^(?:0[9A-D]|20)+", ""))) / 2).cast("int")


def strip_right(content: Column) -> Column:
    """Number of bytes before trailing ASCII white space."""
    pairs = F.regexp_extract_all(F.hex(content), F.lit("(..)"), 1)
    keep = F.transform(pairs, lambda p, i: F.when(~p.isin("09", "0A", "0B", "0C", "0D", "20"), i + 1).otherwise(F.lit(0)))
    return F.when(F.size(pairs) == 0, F.lit(0)).otherwise(F.array_max(keep)).cast("int")


def byte_features(content: Column, size: int = FEATURE_BYTES, block: int = BLOCK_BYTES, padding: int = PADDING) -> Column:
    """ARRAY<INT> of 2 * size: the stripped head from the left, the stripped tail from the right, padding between."""
    head = F.substring(content, 1, block)
    tail = F.when(F.octet_length(content) <= block, head).otherwise(F.substring(content, -block, block))
    values = lambda b: F.transform(F.regexp_extract_all(F.hex(b), F.lit("(..)"), 1), lambda p: F.conv(p, 16, 10).cast("int"))
    first = F.slice(values(head), strip_left(head) + 1, size)
    end = strip_right(tail)
    last = F.slice(values(tail), F.greatest(F.lit(1), end - size + 1), F.least(end, F.lit(size)))
    return F.concat(first, F.array_repeat(F.lit(padding), 2 * size - F.size(first) - F.size(last)), last)


def with_content_type(df: DataFrame, types: DataFrame, label: str = "label") -> DataFrame:
    """Content-type columns of each label; a label that the table lacks becomes the ``unknown`` row, label included.

    A table without that row gives label and description ``unknown``, the
    octet-stream type, group unknown, no extensions, no text.  Rows keep their
    other columns.  ``types`` is a dimension of a few hundred labels; it is
    broadcast only by Spark's own size check, as is its one ``unknown`` row.
    """
    text = F.coalesce("is_text", F.lit(False))
    info = F.struct(
        F.col("label").alias("label"),
        F.coalesce("mime_type", F.when(text, F.lit("text/plain")).otherwise(F.lit("application/octet-stream"))).alias("mime_type"),
        F.coalesce("grp", F.lit("unknown")).alias("grp"),
        F.coalesce("description", "label").alias("description"),
        F.coalesce("extensions", F.array().cast("array<string>")).alias("extensions"),
        text.alias("is_text"),
    )
    none = F.struct(F.lit("unknown").alias("label"), F.lit("application/octet-stream").alias("mime_type"), F.lit("unknown").alias("grp"), F.lit("unknown").alias("description"), F.array().cast("array<string>").alias("extensions"), F.lit(False).alias("is_text"))
    known = types.select(F.col("label").alias("__l"), info.alias("__info"))
    other = types.where("label = 'unknown'").select(F.col("label").alias("__u"), info.alias("__other"))
    joined = df.join(known, F.col(label) == F.col("__l"), "left").join(other, F.when(F.col("__l").isNull(), F.lit("unknown")) == F.col("__u"), "left")
    out = F.coalesce("__info", "__other", none)
    return joined.withColumn("__out", out).select(*(F.col("__out.label").alias(c) if c == label else F.col(c) for c in df.columns), *(F.col(f"__out.{c}").alias(c) for c in ("mime_type", "grp", "description", "extensions", "is_text")))


def auth_reason(complete: Column, feature: Column, similarity: Column, live_score: Column, threshold: float = 0.35, live_least: float = 0.85) -> Column:
    """Outcome of a submitted live check, the first of: ACTION_INCOMPLETE, LIVENESS_FAILED (no feature), SIMILARITY_TOO_LOW, LIVENESS_FAILED, OK."""
    return gate_reason([(complete, "ACTION_INCOMPLETE"), (feature.isNotNull(), "LIVENESS_FAILED"), (similarity >= F.lit(threshold).cast("float"), "SIMILARITY_TOO_LOW"), (live_score >= live_least, "LIVENESS_FAILED")])


def gate_reason(checks: list[tuple[Column, str]], passed: str = "OK") -> Column:
    """Name of the first check that fails (or is null), else ``passed``."""
    out = F.lit(passed)
    for ok, name in reversed(checks):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(name))
    return out


def auth_gate(faces: Column, landmarks: Column, eye_distance: Column, sharpness: Column, ratio: Column, live: Column) -> Column:
    """First reason to refuse a frame of a live check, else OK."""
    return gate_reason([(faces == 1, "FACE_COUNT"), (landmarks, "NO_LANDMARKS"), (eye_distance >= 1, "EYES_TOO_CLOSE"), (sharpness >= 25, "BLURRED"), ((ratio >= 0.08) & (ratio <= 0.90), "FACE_SIZE"), (live, "NOT_LIVE")])


def usability(width: Column, height: Column, least: int) -> Column:
    """STRUCT<usable, reason>; ``least`` 0 turns the check off."""
    small = (F.least(width, height) < least) if least else F.lit(False)
    return F.struct((~small).alias("usable"), F.when(small, F.format_string("size %dx%d is under %d", width.cast("int"), height.cast("int"), F.lit(least))).alias("reason"))


def hex_colour(value: Column) -> Column:
    """STRUCT<r, g, b> of #RGB or #RRGGBB; null for anything else."""
    v = F.regexp_replace(F.trim(value), "^#", "")
    long = F.when(v.rlike("^[0-9A-Fa-f]{6}$"), v).when(v.rlike("^[0-9A-Fa-f]{3}$"), F.regexp_replace(v, "(.)", "$1$1"))
    part = lambda i: F.conv(F.substring(long, i, 2), 16, 10).cast("int")
    return F.when(long.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def base64_bytes(value: Column) -> Column:
    """Bytes of base64 or a data URI: what precedes the first comma (not at the start) goes."""
    at = F.instr(value, ",")
    return F.unbase64(F.trim(F.when(at > 1, F.substr(value, at + 1)).otherwise(value)))


def lines(value: Column) -> Column:
    """Lines ended by LF, CR or CR LF; an empty last line is dropped."""
    parts = F.split(value, "\r\n|\n|\r", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def parse_enum(value: Column, names: list[str]) -> Column:
    """The name that ``value`` equals without regard to case and outer blanks, else null."""
    return F.element_at(_map({n.lower(): n for n in names}), F.lower(F.trim(value)))

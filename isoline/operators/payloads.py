"""Audits of nested JSON payloads of any depth: leaves with their paths, and what they violate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.operators.audit import EMAIL, MEDIA_STARTS, PHONE, PII_KEYS, REDACTED, SECRET_KEYS
from isoline.operators.geometry import checkpointed

# Fixed values of the audit: key hints, flags that must not be true, and what decoded media begin with.
MEDIA_KEYS = ("image", "photo", "video", "frame", "texture", "pixels", "exif", "ultrasound", "dicom", "mask", "overlay", "bytes")
RAW_MEDIA_FLAGS = ("raw_image_sent", "raw_video_sent", "contains_face_image", "contains_raw_media")
CUE_FLAGS = {"used_for_geometry": "secondary_cue_used_for_geometry", "used_for_agent_prompt": "secondary_cue_sent_to_agent_prompt"}
MEDIA_MAGIC = (b"GIF8", b"RIFF", b"DICM")

# Fixed values of the check before a browser's export and of the acceptance evidence.
EXPORT_PHONE = r"(^|[^\d])(?:\+?\d[\d .()\-]{8,}\d)(?!\d)"
EXPORT_MEDIA = r"(?i)^data:(image|video|application/dicom)/"
BASE64 = r"^[A-Za-z0-9+/]+={0,2}$"
BASE64_STARTS = ("/9j/", "iVBORw0KGgo", "R0lGOD", "UklGR", "RElDTQ")
EVIDENCE_FLAGS = (*RAW_MEDIA_FLAGS, "exported_raw_pixels", "exported_landmarks")
EVIDENCE_STARTS = ("data:image/", "data:video/")


def nesting(text: Column) -> Column:
    """How deep a JSON text nests: 0 for a plain value. Of the text only the brackets outside of strings are left, and counted."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(plain, r'"[^"]*"|[^"{}\[\]]+', "")
    step = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    deeper = lambda s, c: F.struct((s["now"] + step(c)).alias("now"), F.greatest(s["most"], s["now"] + step(c)).alias("most"))
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper)["most"]


def json_leaves(df: DataFrame, key: str, payload: str, most: int = 16) -> DataFrame:
    """(key, path, kind, value) for each leaf of JSON texts: path is an array of names and list places, kind STRING, BOOLEAN, VOID or a number's. Texts that are no JSON have none.

    A first pass over the texts tells how deep they nest, so they are taken apart in
    one plan, without a shuffle or a write. Those that nest over most deep go a
    level a round, over what is nested that deep.
    """
    rows = df.select(key, F.col(payload).alias("v"))
    deep = nesting(F.col("v"))
    # The driver sees two numbers.
    depth, beyond = rows.select(deep.alias("deep")).agg(F.max(F.when(F.col("deep") <= most, F.col("deep"))), F.count_if(F.col("deep") > most)).first()
    level = (rows.filter(deep <= most) if beyond else rows).select(key, F.array().cast("array<string>").alias("path"), F.try_parse_json("v").alias("v")).filter("v is not null")
    for _ in range(depth or 0):
        inside = level.withColumnRenamed("v", "held").lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("held").outer()))
        name = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        level = inside.select(level[key], F.when(F.col("pos").isNull(), F.col("path")).otherwise(F.array_append("path", name)).alias("path"), F.when(F.col("pos").isNull(), F.col("held")).otherwise(F.col("value")).alias("v"))
    # What is still nested here is empty.
    leaves = level.withColumn("kind", F.schema_of_variant("v")).filter(~(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))).select(key, "path", "kind", F.col("v").cast("string").alias("value"))
    return leaves.unionAll(_leaves_by_rounds(rows.filter(deep > most), key)) if beyond else leaves


def _leaves_by_rounds(rows: DataFrame, key: str) -> DataFrame:
    """json_leaves() of texts v, one round for each level of nesting."""
    level = rows.select(key, F.array().cast("array<string>").alias("path"), F.try_parse_json("v").alias("v")).filter("v is not null")
    found = []
    while True:
        level = level.withColumn("kind", F.schema_of_variant("v"))
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        found.append(level.filter(~nested).select(key, "path", "kind", F.col("v").cast("string").alias("value")))
        deeper = level.filter(nested).drop("kind")
        inside = deeper.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = checkpointed(inside.select(key, F.array_append("path", F.coalesce(F.col("key"), F.col("pos").cast("string"))).alias("path"), F.col("value").alias("v")))
        if level.isEmpty():
            return reduce(DataFrame.unionAll, found)


def _read_once(leaves: DataFrame) -> DataFrame:
    """json_leaves() rows with what the rules ask for: low_, all names in small letters, one a line; leaf_, the last of them; text_, a STRING's text unless blank."""
    return leaves.withColumns({
        "low_": F.lower(F.array_join("path", "\n")), "leaf_": F.lower(F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(""))),
        "text_": F.when(F.col("kind") == "STRING", F.nullif(F.trim("value"), F.lit(""))),
    })


def _cue(flag: str, true: Column) -> Column:
    """Whether a leaf is a flag that is set within secondary cues."""
    return (F.col("leaf_") == flag) & true & F.exists("path", lambda p: F.lower(p) == "secondary_cues")


def _email(text: Column) -> Column:
    """Whether a text holds an address; texts without an @ are not searched."""
    return F.contains(text, F.lit("@")) & text.rlike(EMAIL)


def payload_violations(leaves: DataFrame) -> DataFrame:
    """Violations (code) of json_leaves() rows: raw media flags, secondary cues that drive geometry or prompts, secrets, personal fields and patterns, embedded media. Numbers and booleans are no text; leaves ending in _present hold no secret."""
    low, leaf, text = F.col("low_"), F.col("leaf_"), F.col("text_")
    true = (F.col("kind") == "BOOLEAN") & (F.col("value") == "true")
    codes = F.array(
        F.when(leaf.isin(*RAW_MEDIA_FLAGS) & true, F.lit("raw_media_flag_true")),
        *(F.when(_cue(flag, true), F.lit(code)) for flag, code in CUE_FLAGS.items()),
        F.when(text.isNotNull() & hinted(low, SECRET_KEYS) & ~F.endswith(leaf, F.lit("_present")) & ~F.lower(text).isin(*REDACTED), F.lit("secret_value_present")),
        F.when(text.isNotNull() & hinted(low, PII_KEYS), F.lit("pii_field_present")),
        F.when(_email(text) | text.rlike(PHONE), F.lit("pii_pattern_present")),
        F.when(hinted(low, MEDIA_KEYS) & embedded_media(text), F.lit("embedded_media_payload")),
    )
    return _read_once(leaves).withColumn("code", F.explode(F.array_compact(codes))).drop("low_", "leaf_", "text_")


def embedded_media(text: Column) -> Column:
    """Whether a text is a media data address, or at least 256 characters of base 64 that decode to media."""
    begins = reduce(lambda a, s: a | F.startswith(text, F.lit(s)), MEDIA_STARTS, F.lit(False))
    head = F.try_to_binary(F.substring(text, 1, 4096), F.lit("base64"))
    decoded = reduce(lambda a, m: a | (F.substring(head, 1, len(m)) == F.lit(m)), MEDIA_MAGIC, F.lit(False))
    return F.coalesce(begins | ((F.length(text) >= 256) & (F.length(text) % 4 == 0) & decoded), F.lit(False))


def export_violations(leaves: DataFrame) -> DataFrame:
    """Violations (code) of json_leaves() rows before an export: as payload_violations(), but cues are named after their flag, leaves ending in _at may look like a phone number or an address, and media are a data address in either case, or at least 256 characters of base 64 that begin as media do."""
    low, leaf, text = F.col("low_"), F.col("leaf_"), F.col("text_")
    true = (F.col("kind") == "BOOLEAN") & (F.col("value") == "true")
    pattern = _email(text) | text.rlike(EXPORT_PHONE)
    coded = (F.length(text) >= 256) & (F.length(text) % 4 == 0) & reduce(lambda a, s: a | F.startswith(text, F.lit(s)), BASE64_STARTS, F.lit(False)) & text.rlike(BASE64)
    rules = (
        ("raw_media_flag_true", leaf.isin(*RAW_MEDIA_FLAGS) & true),
        *((f"secondary_cue_{flag}_true", _cue(flag, true)) for flag in CUE_FLAGS),
        ("secret_value_present", text.isNotNull() & hinted(low, SECRET_KEYS) & ~F.endswith(leaf, F.lit("_present")) & ~F.lower(text).isin(*REDACTED)),
        ("pii_field_present", text.isNotNull() & hinted(low, PII_KEYS)),
        ("pii_pattern_present", ~F.endswith(leaf, F.lit("_at")) & pattern),
        ("embedded_media_payload", hinted(low, MEDIA_KEYS) & (text.rlike(EXPORT_MEDIA) | coded)),
    )
    return _read_once(leaves).withColumn("code", F.explode(F.array_compact(F.array(*(F.when(holds, F.lit(code)) for code, holds in rules))))).drop("low_", "leaf_", "text_")


def hinted(names: Column, hints: tuple[str, ...]) -> Column:
    """Whether some name of a path, joined by lines in small letters, holds one of the hints."""
    return reduce(lambda a, h: a | F.contains(names, F.lit(h)), hints, F.lit(False))


def secret_leaks(leaves: DataFrame) -> DataFrame:
    """Of json_leaves() rows those that leak a secret of a provider's settings: texts and numbers that aren't redacted, under a name that hints at one. The last name that isn't a place in a list may end in _present; booleans and nulls leak nothing."""
    low = F.transform("path", F.lower)
    name = F.try_element_at(F.filter(low, lambda p: ~p.rlike(r"^\d+$")), F.lit(-1))
    held = F.lower(F.trim("value"))
    return leaves.filter(~F.col("kind").isin("BOOLEAN", "VOID") & hinted(F.lower(F.array_join("path", "\n")), SECRET_KEYS) & ~F.endswith(name, F.lit("_present")) & ~held.isin(*REDACTED))


def raw_media_paths(leaves: DataFrame, key: str) -> DataFrame:
    """(key, path) of what json_leaves() rows hold of raw media, each once: flags that are anything but false or null, also a list or an object that isn't empty, and members that are data addresses of images or videos. Names count as they are written; a list's own texts don't."""
    last = F.size("path") - 1
    unset = (F.col("kind") == "VOID") | ((F.col("kind") == "BOOLEAN") & (F.col("value") == "false"))
    ends = F.transform("path", lambda p, i: F.when(p.isin(*EVIDENCE_FLAGS) & ((i < last) | ~unset), i + 1))
    is_address = (F.col("kind") == "STRING") & reduce(lambda a, s: a | F.startswith("value", F.lit(s)), EVIDENCE_STARTS, F.lit(False)) & ~F.try_element_at("path", F.lit(-1)).rlike(r"^\d+$")
    found = F.array_compact(F.concat(ends, F.array(F.when(is_address, F.size("path")))))
    return leaves.select(key, "path", F.explode(found).alias("n")).select(key, F.slice("path", F.lit(1), F.col("n")).alias("path")).distinct()

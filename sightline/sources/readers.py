"""Sources and sinks: files as bytes, label and charset lists, JSON configs and frames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policies import BLOCK_BYTES, lines

FILES = "path string, modificationTime timestamp, length long, content binary"
MODEL_CONFIG = (
    "beg_size int, mid_size int, end_size int, use_inputs_at_offsets boolean, medium_confidence_threshold float, min_file_size_for_dl int, "
    "padding_token int, block_size int, target_labels_space array<string>, thresholds map<string,float>, overwrite_map map<string,string>"
)
FRAMES_JSON = "frames array<struct<timestampMs:bigint,boxes:array<struct<x1:float,y1:float,x2:float,y2:float,score:float,class_id:int>>>>"


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length, content of whole files; a missing path fails, directories are not rows."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "content")


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(path).select("path", "length", "content")


def head_tail(content: Column, block: int = BLOCK_BYTES) -> tuple[Column, Column]:
    """First and last ``block`` bytes; the tail is the head where the content fits one block."""
    head = F.substring(content, 1, block)
    return head, F.when(F.octet_length(content) <= block, head).otherwise(F.substring(content, -block, block))


def path_label(spark: SparkSession, path: str) -> str | None:
    """``directory``, ``unknown`` for what is no regular file, null for a regular file; a missing path fails.

    A driver-side look at one path, before :func:`files` reads it.
    """
    if "://" not in path or path.startswith("file:"):
        local = Path(path.removeprefix("file://").removeprefix("file:"))
        if not local.exists():
            raise FileNotFoundError(path)
        return "directory" if local.is_dir() else None if local.is_file() else "unknown"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    status = fs.getFileStatus(p)
    return "directory" if status.isDirectory() else None if status.isFile() else "unknown"


def labels(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """index, label of the non-blank trimmed lines of each text, in order; a text without label fails."""
    return texts.select(F.posexplode(label_array(F.col(text_col))).alias("index", "label"))


def label_array(text: Column) -> Column:
    """The same as an array; an empty list raises."""
    got = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(got) > 0, got).otherwise(F.raise_error(F.lit("no labels")).cast("array<string>"))


def charset(text: Column) -> Column:
    """Entry 0 is the blank, then every character but line ends, repeats included."""
    chars = F.filter(F.split(text, ""), lambda c: ~c.isin("", "\n", "\r"))
    return F.concat(F.array(F.lit("")), chars)


def model_config(spark: SparkSession, path: str) -> DataFrame:
    """A content-type model's settings; unknown fields are ignored."""
    return spark.read.schema(MODEL_CONFIG).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def content_types(raw: DataFrame) -> DataFrame:
    """Content-type table with defaults: MIME type by ``is_text``, group unknown, description the label, no extensions."""
    text = F.coalesce("is_text", F.lit(False))
    return raw.select(
        "label",
        F.coalesce("mime_type", F.when(text, F.lit("text/plain")).otherwise(F.lit("application/octet-stream"))).alias("mime_type"),
        F.coalesce("grp", F.lit("unknown")).alias("grp"),
        F.coalesce("description", "label").alias("description"),
        F.coalesce("extensions", F.array().cast("array<string>")).alias("extensions"),
        text.alias("is_text"),
    )


def frames(payloads: DataFrame, stream_col: str = "stream_id", json_col: str = "json") -> DataFrame:
    """One row a frame of JSON requests: null frames and boxes are skipped, a missing score is 0.9, frames count from 1."""
    df = payloads.select(stream_col, F.from_json(json_col, FRAMES_JSON)["frames"].alias("f"))
    df = df.select(stream_col, F.posexplode(F.filter("f", lambda x: x.isNotNull())).alias("i", "frame"))
    clean = F.transform(F.filter(F.coalesce(F.col("frame.boxes"), F.array().cast("array<struct<x1:float,y1:float,x2:float,y2:float,score:float,class_id:int>>")), lambda b: b.isNotNull()), lambda b: b.withField("score", F.coalesce(b["score"], F.lit(0.9).cast("float"))).withField("class_id", F.coalesce(b["class_id"], F.lit(0))))
    return df.select(F.col(stream_col).alias("stream_id"), (F.col("i") + 1).alias("frame_idx"), F.col("frame.timestampMs").alias("ts_ms"), clean.alias("boxes"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def write_images(df: DataFrame, path: str, form: str = "png", quality: int = 95, codec=None, name: str = "name", content: str = "pixels", width: str = "width", height: str = "height", channels: int = 3) -> DataFrame:
    """Write raw images as files ``path``/name.form; returns file, bytes (lazily: write or count it once).

    PNG and BMP are written here; for jpg and webp the caller gives
    ``codec(image, form, quality)``.  Quality is clamped to 1 .. 100.  A file
    is written under its final name by whichever attempt ends, always with the
    same content.
    """
    if codec is None and form not in ("png", "bmp"):
        raise ValueError(f"{form} needs a codec")
    quality = min(100, max(1, quality))

    def run(frames):
        import pandas as pd
        from pyarrow import fs

        from ..functions.pixels import encode, image

        for pdf in frames:
            rows = []
            for n, raw, w, h in zip(pdf[name], pdf[content], pdf[width], pdf[height], strict=True):
                img = image(raw, int(w), int(h), channels)
                data = codec(img, form, quality) if codec else encode(img, form)
                f, p = fs.FileSystem.from_uri(f"{path}/{n}.{form}")
                f.create_dir(p.rpartition("/")[0], recursive=True)
                with f.open_output_stream(p) as out:
                    out.write(data)
                rows.append((f"{path}/{n}.{form}", len(data)))
            yield pd.DataFrame(rows, columns=["file", "bytes"])

    return df.select(name, content, width, height).mapInPandas(run, "file string, bytes long")

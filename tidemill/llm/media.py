"""Media columns: images in a binary column, their sizes, thumbnails and hashes."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import jpeg, kernel
from tidemill.llm.work import own_columns

PART_BYTES = 2 << 20


def padded(text: bytes) -> bytes:
    """The text and bytes 255, which UTF-8 never has, up to a positive multiple of an interval."""
    return text + b"\xff" * (max(1, -(-len(text) // jpeg.INTERVAL)) * jpeg.INTERVAL - len(text))


@lru_cache(1 << 12)
def _edges(length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n bands of nearly equal height start and end; a lower image repeats rows."""
    edges = np.arange(n + 1) * length // n
    low = np.minimum(edges[:-1], length - 1)
    return low, np.maximum(low + 1, edges[1:])


def _cells(so_far: np.ndarray, heights: np.ndarray, columns: int) -> np.ndarray:
    """Means of the cells into which columns cut bands of rows, from the bands' sums up to each sample."""
    left, right = _edges(so_far.shape[1] - 1, columns)
    return (so_far[:, right] - so_far[:, left]) / (heights[:, None] * (right - left))


def thumbnail_hashes(thumbnail: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash of a thumbnail, 64 bits each in hex."""
    top, bottom = _edges(len(thumbnail), 8)
    so_far = np.zeros((8, thumbnail.shape[1] + 1), np.int64)
    for k, (a, b) in enumerate(zip(top.tolist(), bottom.tolist(), strict=True)):
        np.add.reduce(thumbnail[a:b], axis=0, dtype=np.int64, out=so_far[k, 1:])
    np.cumsum(so_far, axis=1, out=so_far)
    small, wide = (_cells(so_far, bottom - top, n) for n in (8, 9))
    return (np.packbits(small >= small.mean()).tobytes().hex(), np.packbits(wide[:, 1:] > wide[:, :-1]).tobytes().hex())


def _store(batches):
    for whole in batches:
        for a, b in kernel.runs(whole.column(1), PART_BYTES):
            batch = whole.slice(a, b - a)
            data, at = kernel.buffers(batch.column(1))
            payloads = [padded(data[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(jpeg.encode(payloads), pa.binary())], ["id", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, media): each text's UTF-8 bytes as one grey baseline JPEG, a flat block for each byte.

    Null texts are empty, and empty ones are padding alone. Texts of up to 66 MB
    are one image, longer ones several in one value; working arrays don't grow
    with them. Equal texts give equal images, repeated rows and null ids stay,
    other columns are not read, and an empty table gives an empty result.
    """
    given = own_columns(docs, {"id": id_col, "text": text_col})
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(_store, f"id {kind}, media binary").withColumnRenamed("id", id_col)


FEATURES = "width int, height int, ahash string, dhash string, media_bytes bigint, media_sha256 string, error string"
PAYLOAD = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint"


def features(media: list[bytes | None], with_payload: bool = False) -> list[dict]:
    """Size, thumbnail hashes and payload digests of each column value; several images in one value stand on top of each other."""
    frames, owners, out = [], [], []
    for k, data in enumerate(media):
        row = {"width": None, "height": None, "ahash": None, "dhash": None, "media_bytes": None if data is None else len(data), "media_sha256": None if data is None else hashlib.sha256(data).hexdigest(), "error": "no image" if not data else None}
        out.append(row)
        if data:
            try:
                found = jpeg.parse(data)
                if not found:
                    raise ValueError("no image")
                frames += found
                owners += [k] * len(found)
            except (ValueError, KeyError, IndexError) as e:
                row["error"] = str(e) or type(e).__name__
    try:
        thumbs = jpeg.thumbnails(frames)
    except ValueError:  # one by one, to tell which is damaged
        thumbs = []
        for f, k in zip(frames, owners, strict=True):
            try:
                thumbs.append(jpeg.thumbnails([f])[0])
            except ValueError as e:
                thumbs.append(None)
                out[k]["error"] = str(e)
    by: dict[int, list[int]] = {}
    for i, k in enumerate(owners):
        by.setdefault(k, []).append(i)
    for k, members in by.items():
        if out[k]["error"]:
            continue
        wide = min(thumbs[i].shape[1] for i in members)
        image = np.concatenate([thumbs[i][:, :wide] for i in members]) if len(members) > 1 else thumbs[members[0]]
        ahash, dhash = thumbnail_hashes(image)
        out[k] |= {"width": min(frames[i].width for i in members), "height": sum(frames[i].height for i in members), "ahash": ahash, "dhash": dhash}
        if with_payload:
            payload = image.tobytes()
            text = payload.rstrip(b"\xff")
            payload = payload[: max(1, -(-len(text) // jpeg.INTERVAL)) * jpeg.INTERVAL]
            out[k] |= {"n_bytes": len(text), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:])}
    return out


def _reader(with_payload: bool, schema: pa.Schema):
    def read(batches):
        for whole in batches:
            for a, b in kernel.runs(whole.column(1), 2 * PART_BYTES):
                rows = features(whole.column(1)[a:b].to_pylist(), with_payload)
                ids = whole.column(0)[a:b]
                columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["id", *schema.names])

    return read


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """One row per row of media: id_col and FEATURES, with_payload also PAYLOAD, the bytes that store_texts put there.

    Values that are null, empty or not baseline JPEG get null features and say
    why in error. Equal values have equal features; repeated rows and null ids
    stay. Images of any size that baseline JPEG allows are decoded whole, 2,048 restart intervals at a
    time. Other columns are not read; an empty table gives an empty result.
    """
    given = own_columns(media, {"id": id_col, "media": media_col})
    kind = given.schema["id"].dataType.simpleString()
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    text = FEATURES + (f", {PAYLOAD}" if with_payload else "")
    schema = pa.schema([(n, types[t]) for n, t in (x.split(" ") for x in text.split(", "))])
    return given.mapInArrow(_reader(with_payload, schema), f"id {kind}, {text}").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from media_features with its payload."""
    feature = F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("ahash"), F.lit(":"), F.col("dhash"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))

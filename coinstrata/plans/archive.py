"""Snapshot archives: what is checked before a restore replaces anything."""

from __future__ import annotations

import hashlib
import os
import tarfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinstrata.functions.text import BadArgument, safe_name

# Members of a store's folder that an archive of it must hold, by pattern.
REQUIRED = ("CURRENT", "MANIFEST-")


def members(source: str | Path, limit: int | None = None) -> list[str]:
    """Names of at most limit members of a tar archive, compressed or not."""
    out: list[str] = []
    with tarfile.open(source, "r:*") as t:
        for m in t:
            out.append(m.name)
            if limit is not None and len(out) >= limit:
                break
    return out


def digest(source: str | Path, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(source, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def is_wrapper(names: list[str]) -> bool:
    """An archive of an archive and its checksum file."""
    base = [os.path.basename(n) for n in names]
    return any(n.endswith(".tar.gz") for n in base) and any(n.endswith(".sha256") for n in base)


def holds_store(names: list[str]) -> bool:
    base = [os.path.basename(n) for n in names]
    return all(any(n == r or (r.endswith("-") and n.startswith(r)) for n in base) for r in REQUIRED)


def unwrap(source: str | Path, target: str | Path) -> Path:
    """The inner archive of a wrapper, written to target once its checksum is found right."""
    with tarfile.open(source, "r:*") as t:
        names = {os.path.basename(m.name): m for m in t.getmembers() if m.isfile()}
        inner = next(n for n in names if n.endswith(".tar.gz"))
        wanted = t.extractfile(names[next(n for n in names if n.endswith(".sha256"))]).read().decode().split()[0].lower()
        out = Path(target) / safe_name(inner)
        with t.extractfile(names[inner]) as f, open(out, "wb") as w:
            while part := f.read(1 << 20):
                w.write(part)
    if digest(out) != wanted:
        out.unlink()
        raise BadArgument("the inner archive's checksum is wrong")
    return out


def validated(source: str | Path, work: str | Path, checksum: str | None = None, verify: Callable[[bytes], bool] | None = None) -> Path:
    """The archive to restore from; raises before anything is changed.  verify gets the digest, to hold a signature to it."""
    found = digest(source)
    if verify is not None and not verify(bytes.fromhex(found)):
        raise BadArgument("the signature doesn't fit")
    if checksum is not None and checksum.lower() != found:
        raise BadArgument("the checksum is wrong")
    names = members(source)
    archive = unwrap(source, work) if is_wrapper(names) else Path(source)
    if not holds_store(members(archive)):
        raise BadArgument("the archive holds no store")
    return archive


def restored(check: Callable[[], None], wipe: Callable[[], None], load: Callable[[], None]) -> str:
    """A restore's policy: a failure before the wipe leaves the old state in use, one after it is raised."""
    try:
        check()
    except Exception:  # noqa: BLE001  whatever it was, nothing is lost yet
        return "kept"
    wipe()
    load()
    return "restored"


def file_digests(files: DataFrame) -> DataFrame:
    """SHA-256 of each file of a binaryFile frame."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def chunks_match(chunks: DataFrame, canonical: DataFrame) -> DataFrame:
    """Chunks (name, last, block_hash) whose last block is the node's."""
    node = canonical.select(F.col("height").alias("last"), F.col("block_hash").alias("_theirs"))
    return chunks.join(node, "last", "left").withColumn("reusable", F.coalesce(F.col("_theirs") == F.col("block_hash"), F.lit(False))).drop("_theirs")


def same_source(manifest: dict, header: dict) -> bool:
    """Whether a stage's output was made from this source: chain, net, range, width and count."""
    return all(manifest.get(k) == header.get(k) for k in ("chain", "net", "first", "last", "width", "count"))

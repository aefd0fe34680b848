"""Packs: codecs as programs of their own, run on the executors.

A command is a template of arguments; {in}, {out}, {idx}, {dir}, {recipe} and {pack} stand for paths and a member's number.
No shell is involved. A program works in a scratch folder of its own, which goes when it ends; one that fails, runs too
long or takes too much memory declines its file, and the file stays as it is."""

from __future__ import annotations

import os
import resource
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Seconds and bytes of memory that a program may take.
SECONDS, MEMORY = 60, 2 << 30


def arguments(template: str, **places: str) -> list[str]:
    """The arguments of a command: the template cut at blanks, then its placeholders filled in, so that a path with
    blanks stays one argument; a placeholder without a value is empty."""
    out = []
    for word in template.split():
        for key in ("in", "out", "idx", "dir", "recipe", "pack"):
            word = word.replace("{" + key + "}", places.get(key, ""))
        out.append(word)
    if not out:
        raise ValueError("a command without a program")
    folder = places.get("pack", "")
    if "/" not in out[0] and folder and os.access(f"{folder}/bin/{out[0]}", os.X_OK):
        out[0] = f"{folder}/bin/{out[0]}"
    elif "/" in out[0] and not out[0].startswith("/"):
        out[0] = f"{folder}/{out[0]}"
    return out


def _limited(memory: int):
    def limit() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (memory, memory))

    return limit


def run(template: str, body: bytes, allowed: bool = True, pack: str = "", seconds: int = SECONDS, memory: int = MEMORY) -> bytes | None:
    """What a command makes of a body, from {in} to {out}; None if it declines, or if packs are switched off."""
    if not allowed:
        return None
    with tempfile.TemporaryDirectory() as folder:  # the program's own files, gone with it
        source, target = f"{folder}/in", f"{folder}/out"
        with open(source, "wb") as file:
            file.write(body)
        try:
            done = subprocess.run(arguments(template, **{"in": source, "out": target, "dir": folder, "pack": pack}), cwd=folder, timeout=seconds, preexec_fn=_limited(memory), stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, check=False)
            if done.returncode:
                return None
            with open(target, "rb") as file:
                return file.read()
        except (OSError, subprocess.SubprocessError):
            return None


def executed(files: DataFrame, manifest: dict, command: str, allowed: bool = True, pack: str = "") -> DataFrame:
    """files(ino, body) -> (ino, body): each body through a pack's command; null where the pack declines."""
    template = manifest["commands"][command]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"ino": frame.ino, "body": [None if b is None else run(template, bytes(b), allowed, pack) for b in frame.body]})

    return files.select("ino", "body").mapInPandas(work, "ino long, body binary")


def guarded(files: DataFrame, manifest: dict, allowed: bool = True, pack: str = "") -> DataFrame:
    """files(ino, body) -> (ino, size, packed, verdict): packed by a pack and read back. accept if it comes back the same and
    smaller, else guard (differs), larger or declined."""
    encode, decode = (manifest["commands"][c] for c in ("encode", "decode"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for ino, body in zip(frame.ino, frame.body, strict=True):
                body = bytes(body)
                packed = run(encode, body, allowed, pack)
                if packed is None:
                    rows.append((ino, len(body), None, "declined"))
                elif run(decode, packed, allowed, pack) != body:
                    rows.append((ino, len(body), len(packed), "guard"))
                else:
                    rows.append((ino, len(body), len(packed), "accept" if len(packed) < len(body) else "larger"))
            yield pd.DataFrame(rows, columns=["ino", "size", "packed", "verdict"]).astype({"packed": "Int64"})

    return files.select("ino", "body").mapInPandas(work, "ino long, size long, packed long, verdict string")

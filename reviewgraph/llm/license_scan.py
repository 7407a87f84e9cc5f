"""Licence notices in documents: MinHash bands over overlapping windows, then exact containment.

Texts lose case and ASCII punctuation and become shingles of five words. Templates fall into
classes by length; in each class a document is read in windows twice as long as the longest
template, overlapping by half, so that every whole notice lies inside one. A window retrieves a
template if any band of their MinHash signatures is equal. A band is one hash and there are BANDS
of them: a template in a window has a Jaccard similarity of at least LEAST_JACCARD to it, so that
it is missed with a probability of (1 - LEAST_JACCARD) ** BANDS, under one in ten thousand.
A retrieved template counts if at least 80 % of its shingles are in the window.

Signatures are computed only for windows that hold a shingle of some template: others cannot share
a minimum with one. Documents are scanned row by row, and nothing is shuffled.

Templates of fewer than five words have no shingle. They are searched on their own: a document has
such a notice where all its words stand next to each other in order. Their n_windows is the number
of these places.

Defined results: null and empty texts have no notices. Templates without a word are refused.
Rows with equal ids are scanned each. Extra columns are left out.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches, slices
from reviewgraph.llm.shingles import joined, mixed, word_hashes

SIZE = 5
CONTAINED_PERCENT = 80
BANDS = 72
LEAST_JACCARD = 0.12
CLASS_GROWTH = 1.5
FILTER_BITS = 20
SLICE_BYTES = 1_000_000

# Short public licence notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"),
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met"),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies."),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation"),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "cc-by-4.0-line": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
}
# Fixed value: notices shorter than a shingle.
SHORT_TEMPLATES = {"all-rights-reserved": "All rights reserved."}

_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain(text: str | None) -> bytes:
    """The text's bytes, ASCII punctuation as spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PUNCTUATION)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Shingles in order; a shorter text has none."""
    return joined(words, SIZE) if len(words) >= SIZE else np.empty(0, np.uint64)


@dataclass
class Templates:
    """Names, shingles and signatures of templates, by class of length."""

    names: list[str]
    shingles: list[np.ndarray]
    sizes: list[int]  # words in half a window of the template's class
    signatures: np.ndarray
    seeds: np.ndarray
    every: np.ndarray
    sieve: np.ndarray


def signature(windows: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """The minimum of each hash over each window's shingles."""
    flat = np.concatenate(windows)
    starts = np.cumsum([0, *map(len, windows[:-1])])
    return np.stack([np.minimum.reduceat(mixed(flat ^ s), starts) for s in seeds], axis=1)


def prepared(templates: dict[str, str]) -> Templates:
    """Templates ready to be searched."""
    names, shingles, sizes = [], [], []
    for name, text in sorted(templates.items()):
        words = word_hashes([plain(text)])[0]
        if len(words) < SIZE:
            raise ValueError(f"template {name} has fewer than {SIZE} words")
        half = SIZE
        while half < len(words):
            half = int(np.ceil(half * CLASS_GROWTH))
        names.append(name)
        shingles.append(np.unique(_shingles(words)))
        sizes.append(half)
    seeds = np.random.default_rng(3).integers(1, 1 << 63, BANDS, dtype=np.uint64)
    every = np.unique(np.concatenate([*shingles, np.empty(0, np.uint64)]))
    sieve = np.zeros(1 << FILTER_BITS, bool)
    sieve[every >> np.uint64(64 - FILTER_BITS)] = True
    signatures = signature(shingles, seeds) if shingles else np.empty((0, BANDS), np.uint64)
    return Templates(names, shingles, sizes, signatures, seeds, every, sieve)


def scan_words(templates: Templates, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
    """For each template found: its containment, first word of the best window, and windows."""
    out: dict[int, tuple[float, int, int]] = {}
    grams = _shingles(words)
    if not len(grams) or not len(templates.every):
        return out
    maybe = np.flatnonzero(templates.sieve[grams >> np.uint64(64 - FILTER_BITS)])
    at = np.minimum(np.searchsorted(templates.every, grams[maybe]), len(templates.every) - 1)
    hits = maybe[templates.every[at] == grams[maybe]]
    if not len(hits):
        return out
    for half in sorted(set(templates.sizes)):
        group = [i for i, h in enumerate(templates.sizes) if h == half]
        # A hit lies in the window that begins in its half and in the one before.
        firsts = np.unique(np.concatenate([hits // half, np.maximum(hits // half - 1, 0)]))
        windows = [grams[f * half:f * half + 2 * half - SIZE + 1] for f in firsts.tolist()]
        signs = signature(windows, templates.seeds)
        for t in group:
            for k in np.flatnonzero((signs == templates.signatures[t]).any(axis=1)).tolist():
                own = templates.shingles[t]
                inside = int(np.isin(own, windows[k]).sum())
                if 100 * inside >= CONTAINED_PERCENT * len(own):
                    share, first, n = out.get(t, (0.0, 0, 0))
                    now = inside / len(own)
                    if now > share:
                        share, first = now, int(firsts[k]) * half
                    out[t] = (share, first, n + 1)
    return out


@dataclass
class ShortTemplates:
    """Names of templates shorter than a shingle by their number of words and hash of these."""

    names: dict[int, dict[int, list[str]]]


def prepared_short(templates: dict[str, str]) -> ShortTemplates:
    """Short templates ready to be searched."""
    names: dict[int, dict[int, list[str]]] = {}
    for name, text in sorted(templates.items()):
        words = word_hashes([plain(text)])[0]
        if not 0 < len(words) < SIZE:
            raise ValueError(f"template {name} has no word, or {SIZE} words and more")
        names.setdefault(len(words), {}).setdefault(
            int(joined(words, len(words))[0]), []).append(name)
    return ShortTemplates(names)


def scan_short(templates: ShortTemplates, words: np.ndarray, of: np.ndarray,
               begins: np.ndarray) -> list[tuple[int, str, float, int, int]]:
    """Text, name, containment, first word and number of places of each short notice.

    of is the text of each word, rising; begins is where each text's words begin.
    """
    out = []
    for size, names in templates.names.items():
        if len(words) < size:
            continue
        runs = joined(words, size)
        whole = of[:len(runs)] == of[size - 1:]
        for key, own in names.items():
            at = np.flatnonzero((runs == np.uint64(key)) & whole)
            texts, first, n = np.unique(of[at], return_index=True, return_counts=True)
            for text, k, m in zip(texts.tolist(), at[first].tolist(), n.tolist()):
                out += [(text, name, 1.0, k - int(begins[text]), m) for name in own]
    return out


NOTICES = "license string, containment double, first_word long, n_windows long"


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    templates: dict[str, str] | None = None) -> DataFrame:
    """id_col, license, containment, first_word and n_windows for each notice of a document.

    templates are broadcast: a list of notices, at most a few megabytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    told = TEMPLATES | SHORT_TEMPLATES if templates is None else templates
    if sum(map(len, told.values())) > 8_000_000:
        raise ValueError("templates are broadcast; search a longer list in parts")
    short = {k: x for k, x in told.items() if len(word_hashes([plain(x)])[0]) < SIZE}
    long = {k: x for k, x in told.items() if k not in short}
    shared = spark.sparkContext.broadcast((prepared(long), prepared_short(short)))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, few = shared.value
        for batch in batches:
            texts = [plain(x) for x in batch.column(1).to_pylist()]
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                words, of, _ = word_hashes(texts[done:done + part.num_rows])
                done += part.num_rows
                ends = np.cumsum(np.bincount(of, minlength=part.num_rows))
                begins = np.append(0, ends[:-1])
                at, found = [], []
                for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
                    for t, (share, first, n) in sorted(scan_words(own, words[a:b]).items()):
                        at.append(i)
                        found.append((own.names[t], share, first, n))
                for i, *hit in scan_short(few, words, of, begins):
                    at.append(i)
                    found.append(tuple(hit))
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())),
                     pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()),
                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    names=[id_col, "license", "containment", "first_word", "n_windows"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {NOTICES}")

"""Model scoring hook (R9): a user function scores window batches inside the tasks.

``fn(pdf) -> pdf`` receives a pandas frame of windows (document, window, word_ids, ...) and returns
per-window probability arrays. It runs through ``mapInPandas`` (Arrow batches), so no row passes
through the driver. A model that has to be loaded is given as ``loader``: a function without
arguments that each Python worker calls once and keeps, and that returns ``fn``. Workers tell loaders
apart by their pickled form (code and what they close over), so two models of a session stay two.

With ``batch_size`` the model gets small batches: the windows of each Arrow batch are sorted by length, cut
into batches and their arrays padded to the batch's longest, rounded up to a multiple of 16, so little
work goes into padding. Outputs as long as the padded input are cut back; rows keep their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

OUT_SCHEMA = "document long, window int, word_ids array<int>, probs array<array<double>>"

_LOADED: dict = {}


PADDING = {"word_ids": -1, "label_ids": -100, "pieces": "[PAD]"}
MAX_LOADED = 4
CALL_PIECES = 1 << 16


def identity(loader) -> str:
    """A name for a function: the digest of its pickled form."""
    import hashlib

    from pyspark import cloudpickle
    return hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()


def loaded(loader, key: str):
    """What the loader returned in this worker process, one for each key; the oldest of more than a few goes."""
    if key not in _LOADED:
        while len(_LOADED) >= MAX_LOADED:
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[key] = loader()
    return _LOADED[key]


def in_length_batches(pdf, score, batch_size: int, length: str = "word_ids", padding: dict | None = None, multiple: int = 16):
    """``score`` over batches of ``pdf``'s rows in length order, arrays padded to a common length; its rows in
    the order of ``pdf``."""
    import numpy as np
    import pandas as pd

    padding = PADDING if padding is None else padding
    sizes = pdf[length].map(len).to_numpy()
    order, out = np.argsort(sizes, kind="stable"), []
    for at in range(0, len(order), batch_size):
        rows = order[at:at + batch_size]
        batch, width = pdf.iloc[rows].reset_index(drop=True), -(-int(sizes[rows].max()) // multiple) * multiple
        for c in (c for c in padding if c in pdf.columns):
            batch[c] = pd.Series([[*x, *[padding[c]] * (width - len(x))] for x in batch[c]], dtype=object)
        got = score(batch)
        for c in got.columns:
            if got[c].dtype == object:
                got[c] = pd.Series([x[:n] if isinstance(x, (list, np.ndarray)) and len(x) == width else x
                                    for x, n in zip(got[c], sizes[rows])], dtype=object)
        out.append(got.set_axis(rows, axis=0))
    return pd.concat(out).sort_index().reset_index(drop=True) if out else score(pdf)


def in_calls(pdf, length: str | None, least: int = 1, pieces: int = CALL_PIECES):
    """The rows of ``pdf`` in order, cut into frames of at least ``least`` rows and, beyond those, at most ``pieces``
    entries of the array column ``length``."""
    import numpy as np

    if length is None or not len(pdf):
        yield pdf
        return
    ends = np.cumsum(pdf[length].map(lambda a: 0 if a is None else len(a)).to_numpy(dtype=np.int64))
    at = 0
    while at < len(pdf):
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + pieces, side="right")), at + least), len(pdf))
        yield pdf if to - at == len(pdf) else pdf.iloc[at:to].reset_index(drop=True)
        at = to


def score_windows(windows: DataFrame, fn=None, schema: str = OUT_SCHEMA, loader=None, loader_key: str | None = None,
                  keep: tuple[str, ...] = (), batch_size: int | None = None, padding: dict | None = None) -> DataFrame:
    """Scores of every window; ``keep`` names input columns that are passed on next to the scores. ``loader_key``
    names the model in place of the loader's identity; ``padding`` gives the columns to pad with their fillers."""
    from ..session import ship_package
    ship_package(windows.sparkSession)
    if (fn is None) == (loader is None):
        raise ValueError("give either fn or loader")

    key = loader_key if loader_key is not None or loader is None else identity(loader)
    arrays = [f.name for f in windows.schema.fields if isinstance(f.dataType, ArrayType)]
    length = "word_ids" if "word_ids" in arrays else arrays[0] if arrays else None

    def run(batches):
        score = fn if fn is not None else loaded(loader, key)
        for pdf in (call for batch in batches for call in in_calls(batch, length, batch_size or 1)):
            out = score(pdf) if batch_size is None or not len(pdf) else in_length_batches(pdf, score, batch_size, padding=padding)
            for c in keep:
                out[c] = pdf[c].to_numpy()
            yield out

    types = StructType([*StructType.fromDDL(schema).fields, *[windows.schema[c] for c in keep]])
    return windows.mapInPandas(run, types)


def synthetic_model(pdf):
    """Toy deterministic scorer (the same integer law as plans.synthetic) in numpy."""
    import numpy as np
    import pandas as pd

    out_probs = []
    for doc, win, wids, labs in zip(pdf["document"], pdf["window"], pdf["word_ids"], pdf["label_ids"]):
        wids = np.asarray(wids, dtype=np.int64)
        g = np.asarray(labs, dtype=np.int64)
        h = 13 * int(doc) + 29 * wids + 5 * int(win)
        ent = (g >= 0) & (g < 12)
        m = np.where(ent, 1 + h % 14, 60 + h % 190)
        fav = np.where(ent, np.where(h % 4 == 0, (g + 1) % 12, g), h % 12)
        k = np.arange(12)
        w = 1 + (k[None, :] + h[:, None]) % 5 + np.where(fav[:, None] == k[None, :], 40, 0)
        den = (w.sum(axis=1) * (m + 1)).astype(np.float64)
        p = np.concatenate([w / den[:, None], (m / (m + 1.0))[:, None]], axis=1)
        out_probs.append(list(p))  # numpy rows go to Arrow as they are
    return pd.DataFrame({"document": pdf["document"].astype("int64"), "window": pdf["window"].astype("int32"),
                         "word_ids": pdf["word_ids"], "probs": out_probs})

"""User tokenizers (W1): pieces of words from any tokenizer, with the index of the word each piece came from.

``loader`` is a function without arguments that each Python worker calls once and keeps; it returns
``encode(documents)``, which gets a list of documents (each a list of words) and returns for each document
its pieces and, equally long, the word index of each piece. Whole Arrow batches go to the tokenizer, so
libraries that work on batches are used as such. The output feeds windows, alignment and spans (W2-W8)
like that of the pattern tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.labels import IGNORE_ID, label_to_id_map
from .score import identity, loaded


def subwords(size: int = 4, mark: str = "##"):
    """Loader of a fixed tokenizer: words cut into pieces of ``size`` characters, later pieces marked."""
    def load():
        def encode(documents):
            out = []
            for words in documents:
                pieces, index = [], []
                for i, w in enumerate(words):
                    cut = [w[at:at + size] for at in range(0, len(w), size)]
                    pieces += [p if n == 0 else mark + p for n, p in enumerate(cut)]
                    index += [i] * len(cut)
                out.append((pieces, index))
            return out
        return encode
    return load


def tokenizer_file(path: str):
    """Loader of a tokenizer file of the ``tokenizers`` library, readable on every worker; specials are left out."""
    def load():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(documents):
            found = tokenizer.encode_batch([list(d) for d in documents], is_pretokenized=True, add_special_tokens=False)
            return [(e.tokens, [int(w) for w in e.word_ids]) for e in found]
        return encode
    return load


def split_with_tokenizer(df: DataFrame, loader, tokens: str = "input_tokens", taxonomy=None, word_labels: str = "labels",
                         loader_key: str | None = None) -> DataFrame:
    """W1 (+W6): add ``pieces`` and ``word_ids``, and with a ``taxonomy`` ``label_ids`` (each piece has its word's id, unknown
    labels -100). A word without pieces gets none; a null word is an empty one, a null document has none."""
    import pyarrow as pa

    from ..session import ship_package
    ship_package(df.sparkSession)
    key = loader_key if loader_key is not None else identity(loader)
    ids = F.lit(None).cast("array<int>")
    if taxonomy is not None:
        m = label_to_id_map(taxonomy)
        ids = F.transform(word_labels, lambda x: F.coalesce(m[x], F.lit(IGNORE_ID)).cast("int"))
    src = df.withColumn("_word_label_ids", ids)
    schema = StructType([*df.schema.fields, StructField("pieces", ArrayType(StringType())), StructField("word_ids", ArrayType(IntegerType())),
                         *([StructField("label_ids", ArrayType(IntegerType()))] if taxonomy is not None else [])])

    def run(batches):
        encode = loaded(loader, key)
        for b in batches:
            documents = [["" if w is None else w for w in ws or []] for ws in b.column(tokens).to_pylist()]
            found = encode(documents) if documents else []
            if len(found) != len(documents) or any(len(p) != len(w) for p, w in found):
                raise ValueError("the tokenizer must return pieces and word indices of equal length for every document")
            columns = [b.column(f) for f in b.schema.names if f != "_word_label_ids"]
            columns += [pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([w for _, w in found], pa.list_(pa.int32()))]
            if taxonomy is not None:
                labels = b.column("_word_label_ids").to_pylist()
                columns.append(pa.array([[ys[i] if i < len(ys) else IGNORE_ID for i in w] for (_, w), ys in zip(found, ((y or []) for y in labels))],
                                        pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*[f for f in b.schema.names if f != "_word_label_ids"], "pieces", "word_ids",
                                                             *(["label_ids"] if taxonomy is not None else [])])

    return src.mapInArrow(run, schema)

"""Small documents with every odd case: nulls, empty and long texts, ties, repeats, columns with clashing names."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

#: Names that operators use inside; as extra columns they must not matter.
CLASHING = ["size", "target", "score", "label", "n", "h", "id", "pair", "block", "tile", "component", "dropped", "row", "copies", "name", "turn", "part", "text.x", "__mix_target", "__mix_copies", "__gone", "__dropped", "__id", "__text", "places", "pos", "line", "held_out"]


def words(rng: random.Random, n: int) -> str:
    parts = ["ba", "con", "der", "est", "for", "gan", "hel", "in", "jo", "kal", "lum", "men"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n))


def documents(seed: int = 5, n: int = 60) -> list[dict]:
    rng = random.Random(seed)
    boiler = "All the best offers of the day are listed here"
    out = []
    for i in range(n):
        lines = [words(rng, rng.randint(3, 14)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), boiler)
        if rng.random() < 0.3:
            lines.append(f"Order {rng.randint(100, 999)} was shipped on day {rng.randint(1, 9)} to the customer")
        out.append({"doc_id": i, "text": "\n".join(lines), "source": f"s{i % 4}"})
    long = words(rng, 3000)
    out += [
        {"doc_id": n, "text": None, "source": "s1"}, {"doc_id": n + 1, "text": "", "source": None}, {"doc_id": n + 2, "text": " \n\t ", "source": "s1"},
        {"doc_id": n + 3, "text": out[3]["text"], "source": "s2"}, {"doc_id": n + 4, "text": out[3]["text"].upper(), "source": "s2"},
        {"doc_id": n + 5, "text": long, "source": "s3"}, {"doc_id": n + 6, "text": long.replace("ba", "bo", 3), "source": None},
        {"doc_id": n + 7, "text": "one two", "source": "s3"}, {"doc_id": n + 8, "text": "One  TWO", "source": "s3"}, {"doc_id": None, "text": "no id at all here", "source": "s0"},
        {"doc_id": n + 9, "text": "naïve Σίσυφος İstanbul 😀 x² ½ <|endoftext|> don't", "source": "s0"}, {"doc_id": 7, "text": out[7]["text"], "source": out[7]["source"]},
    ]
    for r in out:
        r |= {"lang": "en", "n_chars": None if r["text"] is None else len(r["text"])}
        r |= {c: -1 for c in CLASHING}
    return out


TYPES = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()} | {c: pa.int64() for c in CLASHING}
SCHEMA = pa.schema(list(TYPES.items()))


def frame(spark, rows: list[dict]):
    kinds = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join(f"`{k}` {kinds[t]}" for k, t in TYPES.items())
    return spark.createDataFrame([tuple(r.get(k) for k in TYPES) for r in rows], schema)


def folder(path, rows: list[dict], embeddings: list[dict] | None = None, labels: list[dict] | None = None) -> str:
    pq.write_table(pa.Table.from_pylist(rows, SCHEMA), f"{path}/documents.parquet")
    kind = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("block", pa.int64())])
    pq.write_table(pa.Table.from_pylist(embeddings or [], kind), f"{path}/embeddings.parquet")
    kind = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist(labels or [], kind), f"{path}/labels.parquet")
    return str(path)

"""Features of documents whose members differ in kind, against a plain Python flatten."""

import json
import math
import random
import re

import pytest

from flintsieve.operators import features
from flintsieve.sources import readers

OPEN = {"features", "feature_vector", "numeric_features"}
COUNTS = {"pcode": "pcode", "pcode_counts": "pcode", "pcode_count": "pcode", "mnemonic": "mnemonic", "mnemonics": "mnemonic", "mnemonic_counts": "mnemonic", "opcode": "mnemonic", "opcode_counts": "mnemonic"}


def key(k):
    return re.sub(r"[^A-Za-z0-9]+", "_", k).strip("_")


def is_number(x):
    return isinstance(x, bool | int | float) and math.isfinite(x)


def flat(doc, prefix=""):
    out = {}
    for k, v in doc.items():
        k = key(k)
        name = f"{prefix}_{k}" if prefix else k
        if not k:
            continue
        if isinstance(v, dict) and k in OPEN:
            out |= flat(v, prefix)
        elif is_number(v):
            out[name] = float(v)
        elif isinstance(v, dict) and k.lower() in COUNTS:
            out |= {f"{COUNTS[k.lower()]}_{key(x)}": float(y) for x, y in v.items() if is_number(y)}
        elif isinstance(v, dict):
            out |= flat(v, name)
        elif isinstance(v, list):
            out |= {f"{name}_{x}": y for x, y in listed(v).items()}
    return out


def stats(xs):
    return {"count": float(len(xs)), "sum": sum(xs), "mean": sum(xs) / len(xs), "max": max(xs), "min": min(xs)}


def listed(values):
    xs = [float(v) for v in values if is_number(v)]
    if xs:
        return stats(xs)
    found = {}
    for v in values:
        if isinstance(v, dict):
            for k, x in flat(v).items():
                found.setdefault(k, []).append(x)
    out = {"count": float(len(values))}
    if found:
        out["dict_count"] = float(sum(isinstance(v, dict) for v in values))
    for k, v in found.items():
        out |= {f"{k}_{s}": x for s, x in stats(v).items()}
    return out


def compare(spark, functions):
    texts = spark.createDataFrame([(f"{k}.json", json.dumps([f])) for k, f in enumerate(functions)], "json_file string, value string")
    found = {r["json_file"]: r.asDict() for r in features.program_features(readers.parse_programs(texts), ["json_file"]).collect()}
    assert len(found) == len(functions)
    for k, f in enumerate(functions):
        row = found[f"{k}.json"]
        row.pop("json_file")
        assert {n: x for n, x in row.items() if x} == pytest.approx({n: x for n, x in flat(f).items() if x})
    names = {n for f in functions for n in flat(f)}
    assert names <= {n for r in found.values() for n in r}


@pytest.mark.parametrize("functions", [
    [{"mnemonic_counts": {"MOV": 1, "mov": 2}, "n": 1}],
    [{"s": {"z": 2}}, {"s": [1, 2]}, {"s": 5}, {"s": "text"}, {"s": None}, {}],
    [{"sinks": [{"a": 1}, 7]}, {"sinks": [{"a": 2}]}],
    [{"l": [[{"a": 1}], {"b": [{"c": [1, {"d": 2}]}, {"c": [{"d": 3}, {"d": "x"}]}]}]}, {"l": []}, {"l": [{"b": "x"}, 's"t\\r[{']}],
    [{"features": {"features": {"x": 1}, "y": [True, False]}}, {"features": [1]}, {"features": 3}],
    [{"A": 1}, {"a": 2}, {"pcode": {"COPY": 3, "x": {"y": 1}}, "PCODE": 4}, {"pcode": 5}],
    [{"n": 1e400, "é-ü": {"": 5, "...": 6, "a.b": 1, "a b": {"c": 1}}}, {"é-ü": 1}],
])
def test_each_document_by_its_own_kinds(spark, functions):
    compare(spark, json.loads(json.dumps(functions).replace("Infinity", "1e308")))


def test_random_documents(spark):
    rnd = random.Random(5)

    def made(depth):
        kind = rnd.choice(["n", "n", "b", "t", "null", "o", "o", "l", "l"] if depth else ["n", "t"])
        if kind == "o":
            return {rnd.choice(["a", "B", "b", "features", "pcode_counts", "x.y"]): made(depth - 1) for _ in range(rnd.randrange(4))}
        if kind == "l":
            return [made(depth - 1) for _ in range(rnd.randrange(4))]
        return {"n": rnd.choice([0, 3, -2.5]), "b": True, "t": "x", "null": None}[kind]

    compare(spark, [d for d in (made(5) for _ in range(300)) if isinstance(d, dict)])


def test_wanted_features_in_order(spark):
    texts = spark.createDataFrame([("a", '[{"s": 1, "t": 2}]'), ("b", '[{"s": [1, 4], "t": 3}]')], "json_file string, value string")
    found = features.program_features(readers.parse_programs(texts), ["json_file"], ["s_max", "none", "t", "s"])
    assert found.columns == ["json_file", "s_max", "none", "t", "s"]
    assert sorted(map(tuple, found.collect())) == [("a", 0.0, 0.0, 2.0, 1.0), ("b", 4.0, 0.0, 3.0, 0.0)]

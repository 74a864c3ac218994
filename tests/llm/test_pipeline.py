"""The pipeline's stages on small tables: columns, effects and whole texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import xxhash

import corpus_pipeline
from helixframe.llm import entries
from helixframe.llm.store import materialise
from tests.llm.conftest import rows
from tests.llm.test_text_operators import WORD, fold


def test_stages(spark, docs, tmp_path):
    own = docs
    for name, stage in corpus_pipeline.STAGES:
        own = materialise(stage(spark, own, str(tmp_path)), name)
        if name != "sequence_packing":
            assert own.columns == docs.columns
        assert own.count() > 0
    assert own.select("doc_id").where("doc_id = 57").isEmpty()  # one repeated word


def test_run_and_empty(spark, docs, tmp_path):
    for n, d in (("full", docs), ("none", docs.limit(0))):
        (tmp_path / n).mkdir()
        d.coalesce(1).write.parquet(str(tmp_path / n / "documents.parquet"))
        assert (corpus_pipeline.run(spark, str(tmp_path / n)).count() > 0) == (n == "full")


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 11))
    assert set(entries.ORACLES) <= set(entries.QUERIES)


BLANK = " \t\n\x0b\x0c\r"


def repeated(w):
    seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    return len({j + x for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for x in range(8)})


def quality(table):
    """(doc_id, text, source) rows that the rules keep, without the lines of more than 20 texts of a host."""
    holders = defaultdict(set)
    for _, t, h in table:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                holders[h, fold(line.strip(BLANK))].add(t)
    out = []
    for i, t, h in table:
        w, lines = WORD.findall(t or ""), (t or "").split("\n")
        above = [bool(WORD.search(x)) and len(holders[h, fold(x.strip(BLANK))]) > 20 for x in lines]
        lost = sum(len(WORD.findall(x)) for x, a in zip(lines, above, strict=True) if a)
        if len(w) >= 20 and 100 * repeated(w) <= 30 * len(w) and lost <= 0.7 * len(w):
            out.append((i, "\n".join(x for x, a in zip(lines, above, strict=True) if not a), h))
    return out


def dedup(table):
    holders = defaultdict(set)
    for i, t, _ in table:
        for line in t.split("\n"):
            holders[fold(line.strip(BLANK))].add(i)
    often = {k for k, v in holders.items() if k and len(v) >= 10}
    return [(i, "\n".join(x for x in t.split("\n") if fold(x.strip(BLANK)) not in often), h) for i, t, h in table]


def fingerprint(t):
    w = WORD.findall(fold(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_each(table):
    own = [fingerprint(t) for _, t, _ in table]
    group = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            if (own[a] ^ own[b]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]

    def place(j):
        h = xxhash.xxh64_intdigest(table[j][1].encode(), 42)
        return table[j][0] is None, table[j][0] or 0, h - (h >> 63 << 64)

    return [table[min((j for j in range(len(table)) if group[j] == g), key=place)] for g in sorted(set(group))]


def mixed(table):
    """{(doc_id, text): how often it is taken}."""
    size = {r: len(WORD.findall(r[1])) for r in table}
    total = defaultdict(int)
    for r in table:
        total[r[2]] += size[r]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    goal, target, open_ = 1.5 * sum(total.values()), {}, set(total)
    while open_:
        level = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} or {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()

    def key(r):
        name = str(r[0]) if r[0] is not None else "text:" + md5(r[1].encode()).hexdigest()
        u = (int(md5(f"mix:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        plain = "".join(c for c in r[1] if c not in "#*$%&|<>{}[]\\^~=_@")
        return -math.log(u) / (0.05 + (len(plain) / max(len(r[1]), 1)) ** 2), str(r[0]), size[r]

    out = {}
    for s in order:
        epochs = int(target[s] // total[s]) if total[s] else 0
        budget, run = target[s] - epochs * total[s], 0
        for r in sorted((r for r in table if r[2] == s), key=key):
            out[r] = epochs + (run + size[r] / 2 <= budget < total[s])
            run += size[r]
    return {(i, t): n for (i, t, _), n in out.items() if n}


def test_run_by_brute_force(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    taken = mixed(one_each(dedup(quality([(i, t, s) for i, t, _, s, *_ in rows()]))))
    assert 20 < len(taken) and len({i for i, _ in taken}) == len(taken)
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(full.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in taken}
    places, windows = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        places.update((r.doc_id, j) for j in range(r.start, r.start + r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert places == Counter({(i, j): n for (i, _), n in taken.items() for j in range(len(ids[i]))})
    assert all(sum(n for _, n in w) <= 2048 and sorted(w)[0][0] == 0 for w in windows.values())

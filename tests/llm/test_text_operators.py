"""Each operator against brute force on rows with every awkward case, and on an empty table."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import line_dedup, media, mixing, packing, quality_lines, sharding, simhash
from helixframe.llm import licenses as lic
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [(i, t or "") for i, t, *_ in rows()]


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_media_roundtrip(docs, empty):
    want = Counter()
    for i, t in TEXTS:
        raw = t.encode()
        own = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[(i, len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), True)] += 1
    got = media.media_report(docs)
    assert bag(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "verified") == want
    assert media.media_report(empty).count() == 0


def test_pcm_blocks_can_be_sought(spark, docs, tmp_path):
    blocks = media.pcm_blocks(media.encode_column(docs.where("doc_id = 56")))
    media.write_pcm_blocks(blocks, str(tmp_path / "pcm"))
    raw = dict(TEXTS)[56].encode()
    found = media.seek(spark, str(tmp_path / "pcm"), 56, 5000, 10).collect()
    assert len(found) == 1 and found[0].verified and found[0].sample_offset == 4096
    pcm = np.frombuffer(found[0].pcm, np.int8).astype(int) + 128
    assert bytes(pcm[5000 - 4096 : 5010 - 4096].astype(np.uint8)) == raw[5000:5010]


def test_damaged_media_is_reported(spark):
    good = media.flac.encode_many([media.to_samples(bytes(range(64)) * 200)])[0]
    bad = bytearray(good)
    bad[-40] ^= 4
    d = spark.createDataFrame([("a", bytes(bad)), ("b", b"no stream"), ("c", None), ("d", good), ("e", good[:42])], "media_id string, media binary")
    got = {i: [r for r in media.pcm_blocks(d).collect() if r.media_id == i] for i in "abcde"}
    assert not all(r.verified for r in got["a"]) and any(r.verified for r in got["a"])
    assert got["b"][0].error and got["c"][0].error and all(r.verified for r in got["d"]) and [r.block for r in got["d"]] == [0, 1, 2, 3]


def test_every_end_of_a_frame_is_tried():
    """False headers inside a frame, more than ten, and a damaged frame among many good ones."""
    flac = media.flac
    head = flac._frame_header(1, 4096, 1, 8)
    noise = np.frombuffer(head * 40 + bytes(np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8)), np.uint8)
    stream = flac.encode_many([media.to_samples(noise.tobytes())])[0]
    (one,) = flac.decode_blocks([stream])
    assert one[1].md5_ok and media.from_samples(one[3]) == noise.tobytes()
    text = media.to_samples(("the quick brown fox " * 9000).encode())
    bad = bytearray(flac.encode_many([text])[0])
    bad[len(bad) // 2] ^= 1
    found = list(flac.decode_blocks([bytes(bad)]))
    assert sum(samples is None for *_, samples in found) == 1 and len(found) == -(-len(text) // flac.BLOCK) and not found[-1][1].md5_ok


def test_long_media_takes_bounded_memory():
    import tracemalloc

    text = ("word and another, " * (1 << 18)).encode()
    tracemalloc.start()
    stream = media.flac.encode_many([media.to_samples(text)])[0]
    coded = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    again = hashlib.md5()
    for *_, samples in media.flac.decode_blocks([stream]):
        again.update(media.from_samples(samples))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    fixed = 1 << 28
    assert again.digest() == hashlib.md5(text).digest() and max(coded, peak) < fixed + 8 * len(text)


def test_license_scan(docs, empty):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t in TEXTS:
        w, places, labels = word.findall(fold(t)), [], set()
        for label, phrase in lic.PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want[(i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += 1
    got = lic.license_report(docs)
    assert bag(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert all(0 <= r.score <= 1 for r in got.collect()) and lic.license_report(empty).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(1)
    runs = [rng.integers(0, 3, 12).tolist() for _ in range(4)]
    text = rng.integers(0, 4, 80).tolist()
    auto = lic.SuffixAutomaton(runs)
    inside = {tuple(r[a:b]) for r in runs for a in range(len(r)) for b in range(a, len(r) + 1)}
    for i, (state, n) in enumerate(auto.statistics(text)):
        assert n == max(m for m in range(i + 2) if tuple(text[i + 1 - m : i + 1]) in inside)
        if n:
            want = {(t, e) for t, r in enumerate(runs) for e in range(n - 1, len(r)) if r[e - n + 1 : e + 1] == text[i + 1 - n : i + 1]}
            assert auto.ends[state] == want


def test_chain_is_the_heaviest():
    rng = np.random.default_rng(2)
    for _ in range(60):
        seeds = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 25, 7), rng.integers(0, 25, 7), rng.integers(1, 6, 7), strict=True)]
        best = {}
        for s in sorted(set(seeds)):
            best[s] = s[2] + max((v for p, v in best.items() if p[0] + p[2] <= s[0] and p[1] + p[2] <= s[1]), default=0)
        assert sum(n for *_, n in lic.chain(seeds)) == max(best.values())


def test_spans_of_a_template():
    text = b"x y this program is free software you can use and redistribute it and or modify it under the terms"
    scan = lic.Scanner().scan(text)
    assert scan.covered["gpl-notice"] > 0.4 and scan.n_base == 0


def covered_by_brute_force(text, template, min_match):
    """Share of the template in the heaviest ascending chain of its own maximal matches."""
    w, least = lic.words_of(text), min(min_match, len(template))
    seeds = []
    for a in range(len(w)):
        for b in range(len(template)):
            if w[a] != template[b] or (a and b and w[a - 1] == template[b - 1]):
                continue
            n = next((j for j in range(min(len(w) - a, len(template) - b)) if w[a + j] != template[b + j]), min(len(w) - a, len(template) - b))
            seeds += [(a, b, n)] if n >= least else []
    best = {}
    for s in sorted(seeds):
        best[s] = s[2] + max((v for p, v in best.items() if p[0] + p[2] <= s[0] and p[1] + p[2] <= s[1]), default=0)
    return max(best.values(), default=0) / len(template)


def test_matches_inside_longer_matches_of_other_templates(spark):
    every, rng = lic.default_templates(), np.random.default_rng(3)
    short = [k for k, t in every.items() if len(t.split()) < 400]
    scanner = lic.Scanner({k: every[k] for k in short})
    notice = lic.NOTICES["apache-notice"]
    texts = [notice, "x licensed under the apache license version 2 0 the license and other words", "all rights reserved " * 3]
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 5)):
            t = every[str(rng.choice(short))].split()
            a, b = sorted(rng.integers(0, len(t) + 1, 2))
            parts += t[a:b] + ["other"] * int(rng.integers(0, 2))
        texts.append(" ".join(parts))
    want = [{k: v for k, t in scanner.templates.items() if (v := covered_by_brute_force(x.encode(), t, scanner.min_match))} for x in texts]
    assert [{k: round(v, 9) for k, v in scanner.scan(x.encode()).covered.items()} for x in texts] == [{k: round(v, 9) for k, v in w.items()} for w in want]
    got = {r.doc_id: r for r in lic.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates={k: every[k] for k in short}).collect()}
    for i, (x, w) in enumerate(zip(texts, want, strict=True)):
        base = set(scanner.scan(x.encode()).base)
        assert abs(got[i].score - max([1.0 if base else 0.0, *w.values()])) < 1e-9
        words = lic.words_of(x.encode())
        for label, at, own, n in got[i].spans:
            assert words[at : at + n] == scanner.templates[label][own : own + n]
        assert got[i].labels == ",".join(sorted({*scanner.scan(x.encode()).base, *(k for k, v in w.items() if v >= lic.MIN_COVER)}))
    assert "apache-short" in got[0].labels.split(",") and "apache-short" in got[1].labels.split(",")


def test_whole_licence_texts(spark):
    """Every text labels itself, wrapped in others' words; half a text is enough and a third is not."""
    every = lic.default_templates()
    assert len(every) > 25 and len(lic.words_of(every["gpl-3.0"].encode())) > 5000
    rows = [(k, "a preface " + t.upper() + " an end") for k, t in every.items()]
    parts = {n: " ".join(every["mpl-2.0"].split()[: int(n * len(every["mpl-2.0"].split()))]) for n in (0.33, 0.6)}
    rows += [(f"mpl {n}", t) for n, t in parts.items()]
    got = {r.doc_id: r for r in lic.license_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(k in got[k].labels.split(",") and got[k].score >= 0.999 for k in every)
    assert "mpl-2.0" in got["mpl 0.6"].labels.split(",") and "mpl-2.0" not in got["mpl 0.33"].labels.split(",")
    assert "bsd-2-clause" in got["bsd-3-clause"].labels.split(",") and "gpl-3.0" not in got["gpl-2.0"].labels.split(",")


def test_added_tokens_are_as_the_tokenizer_loads_them(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    full, token = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = [f"end {token} start", token, token * 3, f"a  {token}  b\n{token}\n", f"x{token}y <|endoftext |>", f"é{token} 漢字 🙂 {token}", "plain  text "]
    want = [full.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=256, with_ids=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found} == dict(enumerate(want))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    want = defaultdict(list)
    for i, t in TEXTS:
        want[i].append(np.array(full.encode(t, add_special_tokens=False).ids + [1], "<u4"))
    found, sequences = defaultdict(Counter), defaultdict(list)
    for r in packing.pack(docs, window=256, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        found[r.doc_id].update(enumerate_ids(r))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in want.items():
        assert found[i] == Counter(p for ids in own for p in enumerate(ids.tolist()))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(len(x) for own in want.values() for x in own)
    assert len(sequences) * 256 - total < 256 + 16 * len(sequences)
    assert packing.pack(empty).count() == 0


def enumerate_ids(r):
    return enumerate(np.frombuffer(r.ids, "<u4").tolist(), r.start)


def test_packing_plan_covers_every_rank():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 65, 3000), np.full(700, 47), np.full(9, 64), rng.integers(1, 3, 500)):
        counts = np.bincount(lengths, minlength=65)
        used, windows = defaultdict(list), defaultdict(int)
        for length, low, high, start, take, sequence, each, _ in packing.packing_plan(counts, 64, 8):
            for r in range(low, high):
                used[length, r].append((start, take))
                windows[sequence + (r - low) // each] += take
        assert all(sum(n for _, n in used[v, r]) == v for v in np.flatnonzero(counts) for r in range(counts[v]))
        assert max(windows.values()) <= 64 and sum(64 - w for w in windows.values()) < 64 + 8 * len(windows)


def test_line_quality(docs, empty):
    def repeats(w):
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {j + x for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for x in range(8)}
        return len(inside)

    want = Counter()
    for i, t in TEXTS:
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n = repeats(w)
        want[(i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w))] += 1
    got = quality_lines.line_quality_report(docs)
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality_lines.line_quality_report(empty).count() == 0


def rules_by_brute_force(table, min_limit, copies):
    """{(doc_id, text, host): (n_boilerplate_words, kept, text left)} by counting every line in every document."""
    holders, hosts = defaultdict(set), Counter(h for _, _, h in table)
    for i, t, h in table:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                holders[h, fold(line.strip(" \t\n\x0b\x0c\r"))].add(i if copies else t)
    out = {}
    for i, t, h in table:
        w, lines = WORD.findall(t or ""), (t or "").split("\n")
        above = [bool(WORD.search(x)) and len(holders[h, fold(x.strip(" \t\n\x0b\x0c\r"))]) > max(min_limit, 1e-4 * hosts[h]) for x in lines]
        lost = sum(len(WORD.findall(x)) for x, a in zip(lines, above, strict=True) if a)
        out[i, t, h] = (lost, len(w) >= 20 and lost <= 0.7 * len(w), "\n".join(x for x, a in zip(lines, above, strict=True) if not a))
    return out


def test_line_rules_by_brute_force(spark):
    """Lines above the limits, depleted documents, copies above the limit, and a line that is frequent on one host alone."""
    noise = [" ".join(f"w{i}x{j}" for j in range(25)) for i in range(60)]
    menu, wide, copy = "Home | About", " ".join(f"b{j}" for j in range(70)), " ".join(f"c{j}" for j in range(40))
    table = [(i, f"{menu}\n{noise[i]}\n  {menu.upper()} \nend {i}" + (f"\n{wide}" if i % 2 else ""), "h") for i in range(30)]
    table += [(30 + i, f"{menu}\n{noise[30 + i]}", "g") for i in range(5)] + [(40 + i, copy, "h") for i in range(25)] + [(80, None, "h"), (81, "", None), (82, menu, None), (None, f"{noise[40]}\n{menu}", "h")]
    d = spark.createDataFrame([*table, table[0]], "doc_id long, text string, source string")
    for copies in (False, True):
        want = rules_by_brute_force([*table, table[0]], 10, copies)
        found = quality_lines.line_quality(d, min_limit=10, copies=copies).select(F.col("doc_id").alias("id"), "n_boilerplate_words", "kept")
        got = {(r.id, r.text, r.source): (r.n_boilerplate_words, r.kept) for r in found.join(d.distinct(), F.col("id").eqNullSafe(F.col("doc_id"))).collect()}
        assert got == {k: v[:2] for k, v in want.items()}
        assert sum(not kept for _, kept, _ in want.values()) > 4 and sum(n > 0 for n, _, _ in want.values()) > 29
        assert (not want[40, copy, "h"][1]) == copies
        left = Counter((r.doc_id, r.text, r.source) for r in quality_lines.clean_documents(d, min_limit=10, copies=copies).collect())
        assert left == Counter((i, want[i, t, h][2] if t else t, h) for i, t, h in [*table, table[0]] if want[i, t, h][1])


def test_depleted_documents_are_rejected(spark):
    noise = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    boiler = " ".join(f"b{j}" for j in range(100))
    d = spark.createDataFrame([(i, (noise[i] + "\n" + boiler), "h") for i in range(30)] + [(i, noise[i], "h") for i in range(30, 40)], "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_lines.clean_documents(d).collect()}
    assert kept == set(range(30, 40))
    assert quality_lines.clean_documents(d, min_limit=50).count() == 40


def test_lines_above_the_limit_are_removed(spark):
    noise = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    own = [(i, f"Menu  \n{noise[i]}\n\n menu\nend {i}", "h", "extra") for i in range(40)]
    d = spark.createDataFrame([*own, own[3], (50, "Menu\n" + noise[0], "other", "extra"), (51, None, None, None)], "doc_id long, text string, source string, at string")
    got = quality_lines.clean_documents(d)
    want = [(i, f"{noise[i]}\n\nend {i}", "h", "extra") for i in [*range(40), 3]] + [(50, "Menu\n" + noise[0], "other", "extra")]
    assert bag(got, *d.columns) == Counter(want)
    report = {r.doc_id: r for r in quality_lines.line_quality_report(d).collect()}
    assert report[3].n_boilerplate_words == 2 and report[50].n_boilerplate_words == 0 and not report[51].kept


def test_mixing(docs, empty):
    got = mixing.mix_report(docs)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    goal, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (goal - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} or {s: level * weights[s] for s in open_}
        open_ = open_ - full if full else set()
    targets = sorted(round(target[s], 6) for _, _, _, s, *_ in rows())
    found = got.collect()
    assert sorted(round(r.target, 6) for r in found) == targets
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()), key=str)
    assert mixing.mix_report(empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(2000)], "doc_id long, text string, source string")
    taken, target = defaultdict(int), {}
    for r in mixing.mix_report(d).join(d.select("doc_id", "source"), "doc_id").collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    assert mixing.mix(d).count() == sum(r.copies for r in mixing.mix(d, repeat=False).collect())


def test_line_dedup(docs, empty):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t in TEXTS:
        for line in t.split("\n"):
            holders[fold(line.strip(strip))].add(i)
    want = Counter()
    for i, t in TEXTS:
        lines = t.split("\n")
        kept = [x for x in lines if not fold(x.strip(strip)) or len(holders[fold(x.strip(strip))]) < 10]
        want[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    assert bag(line_dedup.line_report(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert line_dedup.line_report(empty).count() == 0


def test_line_runs_are_compacted(spark):
    schema = "h1 long, h2 long, doc long"
    runs, known = line_dedup.LineRuns(spark, limit=3, fanout=2), set()
    for batch in range(5):
        own = [(1, 1, batch), (2, batch, batch), (2, batch, batch), (3, batch % 2, batch)]
        assert {(r.h1, r.h2) for r in runs.unseen(spark.createDataFrame(own, schema)).collect()} == {x[:2] for x in own} - known
        runs.add(spark.createDataFrame(own, schema))
        known |= {x[:2] for x in own}
    assert len(runs.levels) > 1 and all(len(level) < 2 for level in runs.levels)
    assert sorted((r.h1, r.h2) for r in runs.frequent().collect()) == [(1, 1), (3, 0)]


def test_runs_are_read_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, limit=2)
    keys = spark.range(1000).selectExpr("id % 300 as h1", "id % 7 as h2", "id as doc")
    runs.add(keys)
    batch = runs._written(keys.groupBy("h1", "h2").count().withColumnRenamed("count", "docs"))
    plan = runs.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "SelectedBucketsCount" in plan


def test_sharding(docs, empty):
    got = sharding.shard_report(docs, leaves=4)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got.collect()) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in TEXTS)
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))  # one text holds over half of all bytes
    assert sharding.shard_report(empty).count() == 0


def test_shards_have_equal_bytes(spark):
    d = spark.createDataFrame([(i, "a" * (i % 50) if i % 3 else "copy", "en", "s") for i in range(3000)], "doc_id long, text string, lang string, source string")
    sums = [r.b for r in sharding.shard_report(d).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.02 * sum(sums) / 8


def test_simhash(docs, empty):
    import xxhash

    def fp(t):
        w = WORD.findall(fold(t))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    own = [(i, fp(t)) for i, t in TEXTS]
    component = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            if (own[a][1] ^ own[b][1]).bit_count() <= 3:
                component = [component[b] if c == component[a] else c for c in component]
    names = {c: min((own[j][0] for j in range(len(own)) if component[j] == c and own[j][0] is not None), default=None) for c in component}
    want = Counter((i, f"{f:016x}", names[c]) for (i, f), c in zip(own, component, strict=True))
    assert bag(simhash.simhash_report(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_report(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.count() == len(names) and kept.columns == docs.columns


def test_identifiers_of_any_type(spark):
    """Names and nulls as identifiers, repeated ones with different texts, through every operator that carries them."""
    texts = ["alpha beta gamma delta " * 9, "other words entirely " * 20, None, "", "GNU General Public License"]
    d = spark.createDataFrame([(f"n{i % 4}" if i < 9 else None, texts[i % 5], "en", f"s{i % 2}", i) for i in range(10)], "doc_id string, text string, lang string, source string, s_id int")
    want = Counter(r.doc_id for r in d.collect())
    reports = [media.media_report, lic.license_report, quality_lines.line_quality_report, mixing.mix_report, line_dedup.line_report, sharding.shard_report, simhash.simhash_report]
    for report in reports:
        assert Counter(r.doc_id for r in report(d).collect()) == want, report
    packed = packing.pack(d, window=64).collect()
    assert Counter(r.doc_id for r in packed if not r.start) == want
    again = packing.pack(d.repartition(3), window=64).collect()
    assert sorted(map(repr, packed)) == sorted(map(repr, again))
    assert {r.component_id for r in simhash.simhash_report(d).collect()} <= set(want)


def test_long_texts_are_whole(spark):
    """One text of some megabytes through every operator that reads texts."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    lines = [" ".join(words[j] for j in rng.integers(0, 5000, 12)) for _ in range(20_000)]
    text = "\n".join(lines) + "\nMIT License"
    d = spark.createDataFrame([(1, text, "en", "s"), (2, "short", "en", "s")], "doc_id long, text string, lang string, source string")
    one = {f.__name__: f(d).where("doc_id = 1").first() for f in (media.media_report, lic.license_report, quality_lines.line_quality_report, line_dedup.line_report, mixing.mix_report)}
    assert one["media_report"].n_bytes == len(text) and one["media_report"].verified
    assert one["license_report"].last_word == one["license_report"].n_words - 2 == 240_000
    assert one["line_quality_report"].n_words == one["mix_report"].size == 240_002
    assert one["line_report"].n_lines == 20_001 and one["line_report"].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
    pieces = sorted((r.start, r.length, r.doc_tokens) for r in packing.pack(d).where("doc_id = 1").collect())
    assert all(a + n == b for (a, n, _), (b, *_) in zip(pieces, pieces[1:], strict=False)) and pieces[-1][0] + pieces[-1][1] == pieces[-1][2]


def test_mixing_with_weights_far_from_one(spark):
    """The sample by any weights against sorting all keys; null and negative weights count as the least."""
    rng = np.random.default_rng(7)
    own = [(i, "w " * int(rng.integers(1, 9)), "s", None if i % 50 == 0 else -1.0 if i % 51 == 0 else float(10.0 ** rng.integers(-5, 6))) for i in range(600)]
    d = spark.createDataFrame(own, "doc_id long, text string, source string, key double")
    size = {i: t.count("w") for i, t, *_ in own}
    w = {i: max(x if x is not None else 0.0, 1e-6) for i, _, _, x in own}
    u = {i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in size}
    budget, run, want = 0.4 * sum(size.values()), 0, set()
    for i in sorted(size, key=lambda i: (-np.log(u[i]) / w[i], str(i), size[i])):
        want |= {i} if run + size[i] / 2 <= budget else set()
        run += size[i]
    got = mixing.mix(d, weight=F.col("key"), share=0.4, weights=(1.0,), epochs=1)
    assert {r.doc_id for r in got.collect()} == want and got.columns == d.columns and 50 < len(want) < 500

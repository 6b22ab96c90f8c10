"""The pipeline's stages against each other and against plain code."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from covey.llm import bpe, line_dedup, mixing, ngram_join, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, ids = docs, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        assert {r.doc_id for r in rows} <= ids
        if name != "bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            assert all(r.n_chars == len(r.text) for r in rows)
        old = {r.doc_id: r.text for r in before.collect()}
        if name == "quality_rules":
            assert {r.doc_id for r in rows} == {i for i, t in old.items() if quality_rules.measures(t.encode())[6]}
        elif name == "line_dedup":
            assert len(rows) == len(old) and all(set(r.text.split("\n")) <= set(old[r.doc_id].split("\n")) for r in rows)
        elif name == "ngram_join":
            assert {r.doc_id for r in rows} == {r.component_id for r in ngram_join.near_groups(before).collect()}
        elif name == "mixing":
            assert len(rows) == sum(r.copies for r in mixing.mix(mixing.sized(before)).collect())
        else:
            t = Tokenizer.from_file(bpe.tokenizer_path())
            for r in rows:
                e = t.encode(old[r.doc_id], add_special_tokens=False).ids
                assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest())
        before, ids = out, {r.doc_id for r in rows}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, before.collect()))


def test_failed_lines_go(spark):
    good, more = "This line says in plain words what it has to say, and it ends well.", "Another sentence follows here with quite different words in it."
    rows = [(1, f"{good}\nHome | About | Contact | Help\n\nAll rights reserved.\n{more}", "en", "s", 9), (2, good, "en", "s", 9), (3, "Home | About | Contact | Help", "en", "s", 9), (4, None, "en", "s", 9)]
    out = corpus_pipeline.rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), SF).collect()
    left = {1: f"{good}\n\n{more}", 2: good}
    assert sorted(tuple(r) for r in out) == [(k, t, "en", "s", len(t)) for k, t in left.items()]


def test_line_stage_of_nothing(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_pipeline(rows):
    """The stages in plain Python: rows of doc_id, text, lang, source, n_chars."""
    import re
    from collections import Counter, defaultdict

    space, blanks = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
    symbols, between = set("#*$%&|<>"), {"|", ">", "/", "-", "·", "»", "›"}
    phrases = ("cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "lorem ipsum", "licensed under", "released under", "copyright", "subscribe to", "sign up", "login to", "log in to")

    def fails(line):
        words = re.findall(space, line)
        n, menu = len(words), sum(w in between for w in words)
        ended = bool(re.search("[.!?…。！？:;][\"'”’»)\\]]*$", line.rstrip(blanks)))
        return (
            sum(c in symbols for c in line) > 0.25 * n or (n >= 3 and sum(w.rstrip(".").endswith(("!!", "??")) for w in words) > 0.5 * n) or menu > max(2, n // 4)
            or (n < 25 and any(p in line.lower() for p in phrases)) or (2 <= n < 10 and not ended)
        )

    kept = []
    for i, text, *rest in rows:
        words = re.findall(space, text or "")
        windows = defaultdict(list)
        for k in range(len(words) - 4):
            windows[tuple(words[k : k + 5])].append(k)
        again = len({p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 5)})
        lines = (text or "").split("\n")
        bad = [bool(x.strip(blanks)) and fails(x) for x in lines]
        lost = sum(len(re.findall(space, x)) for x, b in zip(lines, bad, strict=True) if b)
        if len(words) >= 10 and 100 * again <= 20 * len(words) and lost <= 0.5 * len(words):
            kept.append((i, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b), *rest))
    holders = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blanks))
    for i, text, *_ in kept:
        for x in text.split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    top = {k: max(h) for k, h in holders.items() if len(h) >= 5}
    kept = [(i, "\n".join(x for x in text.split("\n") if top.get(key(x), i) == i), *rest) for i, text, *rest in kept]
    sets = []
    for _, text, *_ in kept:
        w = re.findall(space, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {}
    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ngram_join._union(up, a, b)
    least = {}
    for k, row in enumerate(kept):
        root = ngram_join._find(up, k)
        least[root] = min(least.get(root, row), row)
    kept = sorted(least.values())
    sized = [(("s" + r[3]) if r[3] is not None else "~", len(re.findall(space, r[1])), hashlib.md5(str(r[0]).encode()).hexdigest(), r) for r in kept]
    sizes = Counter()
    for s, n, _, _ in sized:
        sizes[s] += n
    from tests.llm.test_text import water

    target = water({None if s == "~" else s[1:]: n for s, n in sizes.items()})
    out = []
    for s in sizes:
        rate = target[None if s == "~" else s[1:]] / sizes[s]
        offset = int(hashlib.md5(f"mix-1|{s}".encode()).hexdigest()[:13], 16) / 16**13
        for k, x in enumerate(sorted((x for x in sized if x[0] == s), key=lambda x: (-x[1], x[2], x[3][0]))):
            out += [x[3]] * (int(((k + 1) * rate + offset) // 1) - int((k * rate + offset) // 1))
    library = Tokenizer.from_file(bpe.tokenizer_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return sorted((r[0], len(e), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))) for r in out for e in [library.encode(r[1], add_special_tokens=False).ids])


def test_against_plain_code(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == plain_pipeline(rows)


def test_stages_of_awkward_tables(spark, docs, none):
    clash = docs.withColumn("N_Chars2", F.lit(1)).withColumn("__copy", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        out = stage(spark, clash, SF)
        if name != "bpe":
            assert out.columns == clash.columns and {r["__copy"] for r in out.collect()} <= {"x"}
            if name in ("quality_rules", "line_dedup"):
                assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_two_pipelines_at_once(spark):
    """Two runs in two threads of one driver: neither takes away what the other has staged."""
    from concurrent.futures import ThreadPoolExecutor

    rows = lambda: sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()), key=str)
    with ThreadPoolExecutor(2) as pool:
        one, two = (pool.submit(rows) for _ in range(2))
        assert one.result() == two.result() and one.result()

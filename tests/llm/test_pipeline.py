import random

import corpus_pipeline as cp
from strataforge.llm import op2_simhash as sim
from strataforge.llm import op4_pii as pii
from strataforge.llm import op5_quality as ql
from strataforge.llm import op6_mix as mx
from strataforge.llm.components import forest


def documents():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, prose(150), "en", f"s{i % 3}", 0) for i in range(120)]
    base = rows[3][1].split()
    base[50] = "changed"
    rows += [(500, rows[3][1], "en", "s1", 0), (501, " ".join(base), "en", "s2", 0), (502, rows[7][1], None, None, None), (503, None, "en", "s0", 0), (504, "too short", "en", "s0", 0), (505, " ".join(f"{w}%%%" for w in prose(150).split()), "en", "s0", 0)]
    other = rows[11][1].split()
    other[20] = "altered"
    rows.append((507, " ".join(other), "en", "s2", 0))
    rows.append((506, prose(100) + " write to me@mail.example.com now", "en", "s0", 0))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    df = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "mix_sources", "best_fit_packing"]
    docs, frames = df, []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames.append(docs)
    kept, unique, clean, mixed, packed = frames
    for f in frames[:-1]:
        assert f.columns == df.columns
    good = {r["doc_id"] for r in kept.collect()}
    verdict = {r["doc_id"]: r["kept"] for r in ql.judge(ql.quality_metrics(df, keep=["doc_id", "lang", "source"]), ql.fit_thresholds(df)).collect()}
    assert good == {i for i, ok in verdict.items() if ok} and {503, 504, 505} & good == set() and set(range(120)) <= good
    text = {i: t for i, t, *_ in documents() if i in good}
    sets = {i: set(sim.shingle_set(t, 5).tolist()) for i, t in text.items()}
    near = [(i, j) for i in text for j in text if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = forest(near)
    assert {r["doc_id"] for r in unique.collect()} == {i for i in text if root.get(i, i) == i} and not {500, 501, 502, 507} & {r["doc_id"] for r in unique.collect()}
    model = pii.default_model()
    after = {r["doc_id"]: r for r in clean.collect()}
    assert all(r["text"] == pii.redact(text[i], model) and r["n_chars"] == len(r["text"]) for i, r in after.items())
    assert "[EMAIL]" in after[506]["text"]
    copies = {r["doc_id"]: r["copies"] for r in mx.mix_counts(clean).collect() if r["copies"]}
    assert dict(mixed.groupBy("doc_id").count().collect()) == copies
    ids = packed.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in ids} == set(copies)
    want = sorted(map(repr, packed.drop("sequence_id", "offset", "row_id").collect()))
    assert sorted(map(repr, cp.run(spark, str(tmp_path)).drop("sequence_id", "offset", "row_id").collect())) == want


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_rest_works_without_this_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(cp.__file__).parent
    shutil.copytree(root / "strataforge", tmp_path / "strataforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'profile_basic_orders' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}).returncode == 0

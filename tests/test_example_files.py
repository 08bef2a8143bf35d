"""Example files: every example comes back, from files that are compressed and of bounded length."""

from __future__ import annotations

from trailmix.operators import sequences
from trailmix.sources import store


def test_examples_are_compressed_and_whole(spark, tmp_path, random_log, monkeypatch):
    monkeypatch.setattr(store, "EXAMPLES_FILE", 40)
    examples = sequences.instruction_examples(sequences.sliding_examples(random_log(rows=400))).coalesce(1)
    store.write_examples(examples, str(tmp_path / "e"))
    files = sorted((tmp_path / "e").glob("part-*"))
    got = store.read_examples(spark, str(tmp_path / "e"))
    cols = got.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, examples.select(*cols).collect()))
    assert len(files) == -(-got.count() // 40) > 1 and all(f.name.endswith(".json.gz") for f in files)
    examples.select(*cols).write.json(str(tmp_path / "plain"))
    plain = sum(f.stat().st_size for f in (tmp_path / "plain").glob("part-*"))
    assert sum(f.stat().st_size for f in files) < plain / 4

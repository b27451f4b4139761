"""Snapshots: what was indexed, how, from which code, and how large it is."""

import subprocess
from pathlib import Path

from verbatrix.functions import text as T
from verbatrix.operators import chunking, fusion
from verbatrix.sources import records

FIELDS = "id int, text string, company string, form string, period string, strategy string"


def test_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "text", "acme" if i % 3 else "zeta", "10-K", "FY2025", "fixed") for i in range(9)], FIELDS)
    lists = str(tmp_path / "lists")
    spark.range(50).write.parquet(lists)
    out = str(tmp_path / "v1")
    origin = records.provenance(str(Path(records.__file__).parent))
    made = records.snapshot(chunks, out, (chunking.fixed_chunks, fusion.reciprocal_rank_fusion, T.overlap_ratio), {"vectors": lists}, origin, model="none", top=5)
    rows = {r.company: r for r in made.collect()}
    assert {c: (r.form, r.period, r.strategy, r.chunks) for c, r in rows.items()} == {"acme": ("10-K", "FY2025", "fixed", 6), "zeta": ("10-K", "FY2025", "fixed", 3)}
    settings = rows["acme"].settings
    assert settings == {"fixed_chunks.size": "500", "fixed_chunks.overlap": "50", "reciprocal_rank_fusion.k": "60", "overlap_ratio.width": "40", "model": "none", "top": "5"}
    assert rows["zeta"].origin == origin and rows["zeta"].settings == settings
    on_disk = lambda folder: sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file() and not f.name.endswith(".crc"))
    assert rows["acme"].bytes == {"chunks": on_disk(f"{out}/chunks"), "vectors": on_disk(f"{out}/archive/vectors")}
    assert sorted(r.id for r in spark.read.parquet(f"{out}/archive/vectors").collect()) == list(range(50))


def test_no_settings_no_archive_no_chunks(spark, tmp_path):
    made = records.snapshot(spark.createDataFrame([], FIELDS).drop("strategy"), str(tmp_path / "v1"))
    assert made.collect() == [] and {"settings", "origin", "bytes", "strategy"} < set(made.columns)
    one = records.snapshot(spark.createDataFrame([(1, "t", None, None, None)], "id int, text string, company string, form string, period string"), str(tmp_path / "v2")).head()
    assert (one.company, one.chunks, one.strategy, one.settings, one.origin) == (None, 1, None, {}, {})


def test_provenance_of_a_working_copy_and_of_none(tmp_path):
    assert set(records.provenance(str(tmp_path))) == {"error"}
    git = lambda *words: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *words], check=True, capture_output=True)
    git("init", "-b", "work")
    (tmp_path / "f").write_text("1")
    git("add", "f")
    git("commit", "-m", "first")
    told = records.provenance(str(tmp_path))
    assert (told["branch"], told["dirty"], len(told["commit"])) == ("work", "false", 40)
    (tmp_path / "f").write_text("2")
    assert records.provenance(str(tmp_path))["dirty"] == "true"

"""The splittable case source against the whole-text parser, and record boundaries by brute force."""

from __future__ import annotations

import random

import pytest
from test_network import CASE

from gridlake.sources import case as R
from gridlake.sources import case_source as S


def plain(text: str, section: str) -> list[tuple]:
    return [(line, record) for _, line, record in R.records(text, section)]


def scanned(spark, path: str, section: str, split: int) -> list[tuple]:
    name = section.lower()
    rows = S.scan(spark, path, [section], split).orderBy("path", "rec_no").collect()
    return [tuple(r[name]) if r[name] is not None else r["corrupt"] for r in rows]


def rendered(rng: random.Random, n: int) -> str:
    """A case with every section, comments, blank and broken lines, and long names."""
    out = ["0, 100.0", "CASE", "TITLE", "0 / BEGIN BUS DATA"]
    for i in range(n):
        out.append(rng.choice(["", "@ comment", "/ note", f"x{i},'BAD'", f"{i},'B, é{i}',{i / 4},1,1,1,1,1.0,{i}.5\r"]))
    out.append("0 / END OF BUS DATA, BEGIN BRANCH DATA")
    out += [f"{i},{i + 1},'{i % 7} ',0.1,0.2,0.3,'L, {i}',{i % 5},0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,1,{i}.25" for i in range(n)]
    out.append("0 / END OF BRANCH DATA, BEGIN TRANSFORMER DATA")
    out += ["1,0,0"] * 3
    for i in range(n):
        k = i % 3 and i
        lines = [f"{i},{i + 1},{k},'1 ',1,1,1,0,0,2,'T{i}',1", "0.5,1.5,2.5" + (",3,4,5,6,7,8" if k else "")] + ["1,0,0"] * (3 if k else 2)
        if rng.random() < 0.2:
            del lines[rng.randrange(len(lines))]
        elif rng.random() < 0.2:
            lines.insert(rng.randrange(1, len(lines) + 1), "stray,1")
        elif rng.random() < 0.2:
            lines[1] = "broken,,"
        out += lines + [""] * rng.randrange(2)
    out += ["0 / END OF TRANSFORMER DATA, BEGIN OWNER DATA", "6,'HYDRO'", "0 / END OF OWNER DATA", "7,'LATE'"]
    return "\n".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [CASE, rendered(rng, 60), rendered(rng, 9), "", "no sections\n", "0 / BEGIN BUS DATA\n1,'A',1,1,1,1,1,1,1"]


@pytest.mark.parametrize("split", [1 << 20, 1500])
def test_same_as_text_parser(spark, texts, tmp_path, split):
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.raw").write_bytes(text.encode("latin-1"))
    for section in ("BUS", "TRANSFORMER"):
        want = [r if r is not None else line for text in texts for line, r in plain(text, section)]
        got = scanned(spark, str(tmp_path), section, split)
        assert got == want, section
        assert len(want) > 3


@pytest.mark.parametrize("block", [7, 100, 1 << 20])
@pytest.mark.parametrize("split", [1, 13, 64, 700, 1 << 20])
def test_any_split_and_block(texts, tmp_path, monkeypatch, split, block):
    monkeypatch.setattr(S, "BLOCK", block)
    for n, text in enumerate(texts):
        path = tmp_path / f"{n}.raw"
        path.write_bytes(text.encode("latin-1"))
        for section in ("BUS", "BRANCH", "TRANSFORMER", "OWNER"):
            reader = S.CaseReader(str(path), [section], ["corrupt", section.lower()], split)
            rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
            got = [tuple(r[section.lower()].values()) if r[section.lower()] else r["corrupt"] for r in rows]
            assert got == [r if r is not None else line for line, r in plain(text, section)]


def test_many_partitions_and_sections(spark, texts, tmp_path):
    (tmp_path / "a.raw").write_bytes(texts[1].encode("latin-1"))
    df = S.scan(spark, str(tmp_path / "a.raw"), ["BUS", "BRANCH", "TRANSFORMER"], 900)
    assert df.rdd.getNumPartitions() > 10
    counts = {r["section"]: r["count"] for r in df.groupBy("section").count().collect()}
    assert counts == {s: len(plain(texts[1], s)) for s in ("BUS", "BRANCH", "TRANSFORMER")}
    pruned = spark.read.format("case").schema("rec_no long, owner struct<owner int, owner_name string>").load(str(tmp_path))
    assert [tuple(r.owner) for r in pruned.collect()] == [(6, "HYDRO")]
    with pytest.raises(Exception, match="unknown sections"):
        spark.read.format("case").option("sections", "BUSES").load(str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        R.read_case(spark, str(tmp_path / "none.raw"), "BUS")


def test_sections_are_parsed_once(spark, texts, tmp_path):
    (tmp_path / "a.raw").write_bytes(texts[1].encode("latin-1"))
    found = R.read_sections(spark, str(tmp_path / "a.raw"), "BUS", "BRANCH")
    for s, df in found.items():
        assert df.columns == [c for c, _ in R.columns(s)]
        assert [tuple(r)[1:] for r in df.orderBy("rec_no").collect()] == [r for _, r in plain(texts[1], s) if r is not None]
        plan = df.select("rec_no", df.columns[1])._jdf.queryExecution().executedPlan().toString()
        assert "section=" in plan or "PartitionFilters" in plan
        assert "PythonDataSource" not in plan and "case" not in plan.split("PartitionFilters")[0].split("parquet")[0].lower()


def test_records_broken_at_every_line():
    """Whatever line of a record is dropped, doubled or broken, the other records stay and only the broken one is listed."""
    good = [
        ["1,2,0,'1 ',1,1,1,0,0,2,'A',1", "0.1,0.2,3", "1,0,0", "1,0"],
        ["3,4,5,'1 ',1,1,1,0,0,2,'B',1", "1,2,3,4,5,6,7,8,9", "1,0,0", "1,0,0", "1,0,0"],
        ["6,7,0,'2 ',1,1,1,0,0,2,'C',0", "0.4,0.5,6", "1,0,0", "1,0"],
    ]
    names = [r[0] for r in good]
    for which in range(3):
        for at in range(len(good[which])):
            for how in ("drop", "spoil", "double"):
                rows = [list(r) for r in good]
                first = rows[which][0]
                if how == "drop":
                    del rows[which][at]
                elif how == "spoil":
                    rows[which][at] = "?,?,?" if at else "x,2,0,'1 ',1,1,1,0,0,2,'A',1"
                else:
                    rows[which].insert(at, rows[which][at])
                numbered = list(enumerate(line for r in rows for line in r))
                found = list(R.transformer_records(iter(numbered)))
                kept = [line for _, line, record in found if record is not None]
                bad = [line for _, line, record in found if record is None]
                others = [n for n in names if n != names[which]]
                assert [k for k in kept if k in others] == (others if not (how == "drop" and at == 0 and which) else others), (which, at, how)
                if how == "drop" and at == 0:
                    assert bad == [rows[which][0]] and names[which] not in kept
                elif how == "drop":
                    assert bad == [first] and names[which] not in kept
                elif how == "spoil" and at < 2:
                    assert bad == [rows[which][0]] and names[which] not in kept
                elif how == "spoil":  # winding lines are not read
                    assert bad == [] and kept == names
                elif at == 0:  # a head without lines, then the record
                    assert bad == [first] and kept == names
                else:  # one line too many
                    assert len(bad) == 1 and "'" not in bad[0] and (kept == names or at == 1)

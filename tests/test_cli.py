"""The command line from reads to answers, with both plans and all topologies."""

import random

import pytest

from kmerloom import cli


def test_from_reads_to_answers(spark, tmp_path):
    random.seed(1)
    reads = {f"e{i}": "".join(random.choice("ACGT") for _ in range(120)) for i in range(4)}
    for n, s in reads.items():
        (tmp_path / f"{n}.fa").write_text("".join(f">r{j}\n{s}\n" for j in range(3)))
    (tmp_path / "q.txt").write_text(reads["e2"][10:70] + "\n  " + reads["e0"][:50] + " \r\nACGT\n")
    at = lambda x: str(tmp_path / x)
    run = lambda *a: cli.run(spark, list(a))
    run("hashes", at("spec"), "--k", "11", "--bits", "4096")
    run("count", at("spec"), at("*.fa"), at("index"))
    answers = []
    run("build", at("index"), "--topology", "balanced")
    run("cluster", at("index"), at("plan"), "--slots", "8")
    for build in (["build", at("index")], ["build", at("index"), "--topology", "greedy"], ["build_from_merges", at("index"), at("plan")]):
        run(*build)
        run("compress", at("index"))
        assert run("check", at("index")).startswith("every node")
        for plan in ("flat", "tree"):
            run("query", at("index"), at("q.txt"), at("out"), "--plan", plan)
            answers.append([r.value for r in spark.read.text(at("out")).collect()])
    assert all(a == answers[0] for a in answers)
    assert answers[0] == [f"*{reads['e2'][10:70]} 1", "e2", f"*{reads['e0'][:50]} 1", "e0"]
    assert run("draw", at("index")).count("->") == 6
    assert int(run("sim", at("index"), "e0", "e1", "--sim-type", "0")) < 4096
    run("merges", at("index"), at("lines"))
    assert spark.read.text(at("lines")).count() == 3
    assert len(run("sizes", at("index")).split("\n")) == 7 and len(run("popcount", at("index")).split("\n")) == 4
    assert len(run("first_bits", at("index"), "--n", "5").split("\n")) == 20
    for kind in ("0", "1", "2", "3", "-1"):
        assert run("sim", at("index"), "e0", "e1", "--nodes", "--sim-type", kind).lstrip("-").isdigit()
    run("similar", at("index"), at("pairs"), "--slots", "8", "--least", "0.1")
    assert spark.read.parquet(at("pairs")).columns == ["i", "j", "same"]
    run("cluster", at("index"), at("plan1"), "--slots", "8", "--rounds", "one")
    assert spark.read.text(at("plan1")).count() == 3
    with pytest.raises(SystemExit):
        run("unknown")


def test_long_kmers_choose_their_family(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "a.fa").write_text(">r\n" + "ACGTTGCAACGTATTC" * 5 + "\n")
    cli.run(spark, ["hashes", at("spec"), "--k", "33", "--bits", "65536"])
    cli.run(spark, ["count", at("spec"), at("a.fa"), at("index"), "--cutoff", "1"])
    (tmp_path / "q").write_text(("ACGTTGCAACGTATTC" * 5)[3:60])
    cli.run(spark, ["build", at("index")])
    cli.run(spark, ["query", at("index"), at("q"), at("out")])
    assert [r.value for r in spark.read.text(at("out")).collect()][1] == "a"
    with pytest.raises(ValueError):
        cli.run(spark, ["hashes", at("spec"), "--k", "33", "--family", "universal"])


def test_weights_and_segments(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    random.seed(3)
    seqs = ["".join(random.choice("ACGT") for _ in range(60)) for _ in range(3)]
    for i, s in enumerate(seqs):
        (tmp_path / f"e{i}.fa").write_text(f">r\n{s}\n")
    cli.run(spark, ["hashes", at("spec"), "--k", "9"])
    (tmp_path / "q").write_text("\n".join(s[:30] for s in seqs))
    (tmp_path / "w").write_text("\n".join(" ".join(["0.1" if i == 1 else "1"] * 22) for i in range(3)))
    cli.run(spark, ["weighted_query", at("spec"), at("*.fa"), at("q"), at("w"), at("out"), "--cutoff", "1"])
    assert sorted((r.query_id, r.exp_id) for r in spark.read.parquet(at("out")).collect()) == [(0, "e0"), (2, "e2")]
    (tmp_path / "s").write_text(f"[{seqs[1][:20]}][{seqs[1][20:40]}]-[{seqs[2][:20]}]\n[{seqs[0][:20]}]+[{seqs[2][:20]}]\n")
    cli.run(spark, ["segment_query", at("spec"), at("*.fa"), at("s"), at("seg"), "--cutoff", "1"])
    assert [(r.query_id, r.exp_id) for r in spark.read.parquet(at("seg")).collect()] == [(0, "e1")]

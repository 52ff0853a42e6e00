"""Commands: ``python -m helixframe.cli <command> ...``."""

import argparse
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helixframe.operators import compare, hmm, inherit, kernels, simulate
from helixframe.operators import kmers as K
from helixframe.plans import draft as D
from helixframe.plans import posterior as Q
from helixframe.plans import samples
from helixframe.plans.durable import cut
from helixframe.sources import fasta, formats


def save(text: str, path: str, spark: SparkSession) -> None:
    fasta.write_lines(fasta.lines_of(spark, text), path, ["i"])


def load_text(spark: SparkSession, path: str) -> str:
    return fasta.text_of(fasta.read_lines(spark, path), ["i"])


def load(spark: SparkSession, path: str):
    return formats.read_dbg(fasta.read_lines(spark, path))


def store(g, prefix: str) -> None:
    fasta.write_lines(formats.dbg_lines(g), f"{prefix}.dbg", formats.ORDER)
    fasta.write_lines(formats.gfa_lines(g), f"{prefix}.gfa", formats.ORDER)


def raw_dbg(spark, a):
    fasta.write_lines(formats.raw_gfa_lines(K.remove_rare(K.from_fragments(fasta.read_reads(spark, a.reads), a.k), a.min_count), a.k), f"{a.out}.gfa", formats.ORDER)


def draft(spark, a):
    store(D.draft(fasta.read_reads(spark, a.reads), a.k, a.error, a.genome_size, a.haplotypes, a.min_count), a.out)


def infer(spark, a):
    reads = fasta.read_reads(spark, a.reads)
    bases = reads.agg(F.sum(F.length("seq"))).first()[0]
    g, post = Q.infer(load(spark, a.dbg), reads, a.k_final, hmm.Params.uniform(a.error_infer), hmm.Params.uniform(a.error), a.genome_size, a.sigma, bases / a.genome_size)
    store(g, a.out)
    save(formats.inspect_text(g, post), f"{a.out}.inspect", spark)
    save(formats.post_text(post), f"{a.out}.post", spark)
    save("\n".join(f">{','.join(map(str, w))}\n{s}" for s, w in g.linear_haplotypes()), f"{a.out}.euler.fa", spark)


def euler(spark, a):
    g = load(spark, a.dbg)
    save("\n".join(f">p{i} {style}\n{seq}" for i, (style, seq, _) in enumerate(g.styled_seqs())), a.out, spark)


def make_dataset(spark, a):
    haps, reads, params = simulate.dataset(spark, a.name, a.seed)
    fasta.write_genome(haps, f"{a.out}.genome.fa")
    fasta.write_reads(reads, f"{a.out}.reads.fa")
    fasta.write_sam(haps, reads, f"{a.out}.sam")
    fasta.write_dataset(haps, reads, {"p_mismatch": params.p_mismatch, "p_open": params.p_open, "p_ext": params.p_ext}, f"{a.out}.json")


def mapping(spark, a):
    reads = fasta.read_reads(spark, a.reads)
    fasta.write_lines(formats.map_lines(Q.map_reads(load(spark, a.dbg), reads, hmm.Params.uniform(a.error)), reads), a.out, ["i"])


def extend_mapping(spark, a):
    """Carry the mapping of reads from the graph's k to --k-final, and say at each k how it agrees with a fresh one."""
    got = inherit.check(load(spark, a.dbg), fasta.read_reads(spark, a.reads), hmm.Params.uniform(a.error), a.k_final)
    lines = got.select(F.col("k").alias("i"), F.concat_ws("\t", F.col("k").cast("string"), F.col("bases").cast("string"), F.format_string("%.6f", "same_top"), F.format_string("%.6f", "distance")).alias("line"))
    fasta.write_lines(lines, a.out, ["i"])


def table(spark, a):
    """Most probable states after each base of the first read: with the mapping of a MAP file, and without."""
    g = load(spark, a.dbg)
    read = fasta.read_reads(spark, a.reads).where("read_id = 0")
    model, at = g.model(hmm.Params.uniform(a.error)), {e: i for i, e in enumerate(g.node_ids())}
    seq = read.first()["seq"]
    rows = formats.read_map(fasta.read_lines(spark, a.map)).where("read_id = 0").groupBy("pos").agg(F.collect_list("node").alias("n")).orderBy("pos").collect()
    runs = {"with": hmm.run(model, seq, "mapping", [[at[n] for n in r["n"]] for r in rows]), "without": hmm.run(model, seq, "sparse")}
    for name, (f, b) in runs.items():
        print(f"{name}\tF={hmm.full_prob(f)}\tB={hmm.full_prob_backward(b)}")
    for i in range(len(seq)):
        for name, (f, _) in runs.items():
            best = hmm.top_nodes(f[i], 5)
            print(f"{i}\t{name}\t{hmm.mapping_text(best, [f[i].lp(x) for x in f[i].total()[best]])}")


def neighbors(spark, a):
    """Scores of the rescue moves of the edges without copies, or of those that --edges names."""
    g, reads = load(spark, a.dbg), fasta.read_reads(spark, a.reads)
    params = hmm.Params.uniform(a.error)
    mappings = cut(Q.map_reads(g, reads, params))
    bases = reads.agg(F.sum(F.length("seq"))).first()[0]
    freqs = Q.compact_freqs(g, hmm.mapping_freqs(mappings), bases / a.genome_size)
    wanted = {int(e) for e in a.edges.split(",") if e}
    moves = [u for u in Q.moves(g, "R", freqs) if not wanted or u.cycle[0][0] in wanted]
    copies = [kernels.apply_cycle(g.facts("copies"), list(u.cycle)) for u in moves]
    for u, s in zip(moves, Q.Problem(reads, params, a.genome_size, a.sigma, mappings).scores(g, copies) if moves else [], strict=True):
        print(f"{u}\t{s.p}\t{s.to_json()}")


def sample_from_true(spark, a):
    """Search from the copy numbers of the genome, and the samples as INSPECT and GFA files."""
    g, reads, haps = load(spark, a.dbg), fasta.read_reads(spark, a.reads), fasta.read_genome(spark, a.genome)
    true = g.copy_nums_of_paths(g.paths_of(haps))
    g = g.set_copy_nums({r["edge_id"]: r["copy_num"] for r in true.collect()})
    params = hmm.Params.uniform(a.error)
    best, post = Q.sample_posterior(g, Q.Problem(reads, params, a.genome_size, a.sigma, cut(Q.map_reads(g, reads, params))))
    store_ = samples.of_frame(post.frame(spark))
    known = true.select(F.col("edge_id").alias("edge"), "copy_num")
    fasta.write_lines(samples.inspect_lines(store_, g.k, samples.graph_facts(best), known), f"{a.out}.inspect", formats.ORDER)
    fasta.write_lines(samples.gfa_lines(best, store_, known), f"{a.out}.gfa", formats.ORDER)


def freq(spark, a):
    g, true = load(spark, a.dbg), load(spark, a.true)
    f = lambda x: x.compact_seqs().select(F.col("kmer").alias("edge_id"), "copy_num")
    compare.copy_num_errors(f(g), f(true)).show()


def inspect(spark, a):
    g, reads = load(spark, a.dbg), fasta.read_reads(spark, a.reads)
    print(Q.Problem(reads, hmm.Params.uniform(a.error), a.genome_size, a.sigma).scores(g, [g.facts("copies")])[0])


def sample(spark, a):
    g, reads = load(spark, a.dbg), fasta.read_reads(spark, a.reads)
    problem = Q.Problem(reads, hmm.Params.uniform(a.error), a.genome_size, a.sigma)
    _, post = Q.sample_posterior(g, problem, rescue_only=a.rescue)
    print(formats.inspect_text(g, post))


def modify(spark, a):
    g = load(spark, a.dbg)
    post = formats.read_post(load_text(spark, a.post), [e for e, _, _ in g.local()])
    store(g.set_copy_nums(formats.ranked(post)[a.rank].as_dict()), a.out)


def edit_dist(spark, a):
    g, haps = load(spark, a.dbg), fasta.read_genome(spark, a.genome)
    asm = spark.createDataFrame([(i, s) for i, (_, s, _) in enumerate(g.styled_seqs())], "path_id long, path string")
    haps.crossJoin(F.broadcast(asm)).select("hap_id", "path_id", F.levenshtein("seq", "path").alias("distance")).show()
    if a.align:
        for h in haps.collect():
            for _, s, _ in g.styled_seqs():
                print(h["hap_id"], *kernels.align(h["seq"], s))


def speed(spark, a):
    g = load(spark, a.dbg)
    model, reads = g.model(hmm.Params.uniform(a.error)), [r["seq"] for r in fasta.read_reads(spark, a.reads).limit(20).collect()]
    for name, f in (("dense", lambda: [hmm.full_prob(hmm.forward(model, x)) for x in reads]), ("batched", lambda: hmm.forward_scores(model, reads)), ("sparse", lambda: [hmm.score(model, x) for x in reads]), ("sparse by count", lambda: [hmm.score(model, x, by_ratio=False) for x in reads])):
        t = time.perf_counter()
        f()
        print(f"{name}: {time.perf_counter() - t:.3f} s")


def show(spark, a):
    fasta.scan(spark, a.reads).show(truncate=60)


COMMANDS = {
    "raw-dbg": (raw_dbg, "reads out"), "draft": (draft, "reads out"), "infer": (infer, "dbg reads out"), "euler": (euler, "dbg out"), "dataset": (make_dataset, "name out"), "mapping": (mapping, "dbg reads out"), "freq": (freq, "dbg true"),
    "inspect": (inspect, "dbg reads"), "sample": (sample, "dbg reads"), "modify": (modify, "dbg post out"), "extend-mapping": (extend_mapping, "dbg reads out"), "table": (table, "dbg reads map"), "neighbors": (neighbors, "dbg reads"), "sample-from-true": (sample_from_true, "dbg reads genome out"), "edit-dist": (edit_dist, "dbg genome"), "speed": (speed, "dbg reads"), "show": (show, "reads"),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="helixframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, places) in COMMANDS.items():
        s = sub.add_parser(name)
        for x in places.split():
            s.add_argument(x)
        for opt, kind, default in (("-k", int, 40), ("--k-final", int, 100), ("--genome-size", int, 1000), ("--sigma", int, 100), ("--error", float, 0.001), ("--error-infer", float, 0.00001), ("--haplotypes", int, None), ("--min-count", int, 2), ("--rank", int, 0), ("--seed", int, 0), ("--edges", str, "")):
            s.add_argument(opt, type=kind, default=default)
        s.add_argument("--rescue", action="store_true")
        s.add_argument("--align", action="store_true")
    a = p.parse_args(argv)
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    COMMANDS[a.command][0](SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()

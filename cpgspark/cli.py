"""Commands over a saved store: python -m cpgspark.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cpgspark")
    from .operators.calls import METHODS

    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple[str, dict]) -> None:
        s = sub.add_parser(name)
        for flag, kw in flags:
            s.add_argument(flag, **kw)

    store, out = ("store", {}), ("out", {})
    groups = (("--case", {"nargs": "+", "required": True}), ("--control", {"nargs": "+", "required": True}), ("--single", {"action": "store_true", "help": "allow groups of one sample"}))
    add("convert", ("sheet", {}), out, ("--treatment", {"required": True}), ("--control-group", {"required": True}), ("--format", {"default": "bismark", "choices": ["bismark", "methyldackel", "combined_strand_bed"]}), ("--canonical-only", {"action": "store_true"}))
    add("filter", store, out, ("--min-coverage", {"type": int, "default": 10}), ("--quantile", {"type": float, "default": 0.999}))
    add("summary", store, out)
    sites = (
        ("--test", {"default": "auto"}),
        ("--sheet", {"default": None, "help": "CSV with sample_id and covariates"}),
        ("--formula", {"default": None}),
        ("--contrast", {"default": None}),
        ("--covariates", {"nargs": "+", "default": None}),
        ("--unite", {"default": "union"}),
        ("--reference", {"default": "adaptive"}),
        ("--chromosomes", {"nargs": "+", "default": None}),
        ("--canonical-only", {"action": "store_true"}),
    )
    perm = (("--empirical", {"action": "store_true"}), ("--n-perm", {"type": int, "default": 100}), ("--seed", {"type": int, "default": 42}))
    add("dmc", store, out, *groups, *sites, *perm, ("--dispersion", {"default": "eb"}), ("--fdr", {"default": "fdr_bh"}), ("--neighbours", {"action": "store_true"}), ("--neighbour-bp", {"type": int, "default": 500}), ("--separation", {"action": "store_true"}), ("--smoothing-bp", {"type": int, "default": None}), ("--power-stack", {"action": "store_true"}))
    numbers = [("--alpha", float), ("--min-abs-diff", float), ("--merge-bp", int), ("--min-cpgs", int), ("--pct-sig", float), ("--min-len", int)]
    add("dmr", store, out, *groups, *sites, *perm, ("--method", {"default": "chain_merge", "choices": METHODS}), ("--preset", {"default": None}), *((f, {"type": t, "default": None}) for f, t in numbers), ("--use-q", {"action": "store_true"}), ("--q-below", {"type": float, "default": 0.05}), ("--window-bp", {"type": int, "default": 500}), ("--min-sig", {"type": int, "default": 3}), ("--tile-size", {"type": int, "default": 1000}), ("--tile-min-cpgs", {"type": int, "default": 5}), ("--no-merge", {"dest": "merge_adjacent", "action": "store_false"}), ("--dispersion", {"default": "site"}), ("--fdr-method", {"default": "max_t", "choices": ["max_t", "region"]}))
    add("dvc", store, out, *groups, ("--alpha", {"type": float, "default": 0.05}))
    add("report", store, out, ("--sites", {"default": None}), ("--regions", {"default": None}), ("--title", {"default": "Methylation"}))
    add("qc-report", store, out)
    add("smooth", store, out, ("--method", {"default": "gaussian"}), ("--bandwidth", {"type": float, "default": 1000}))
    add("aggregate-regions", store, ("bed", {}), out)
    add("annotate", ("sites", {}), ("gtf", {}), out)
    add("export", store, out, ("--sample", {"required": True}), ("--value", {"default": "beta"}))
    return p


def check_groups(case: list[str], control: list[str], single: bool) -> None:
    if not single and min(len(case), len(control)) < 2:
        raise ValueError("each group needs two samples, unless --single is given")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from .operators import annotate, calls, qc, site_tests, smooth
    from .operators.aggregate import sample_summary
    from .operators.prep import aggregate_regions, filter_sites
    from .sources import readers, report, writers
    from .sources.results import ensure_converted
    from .sources.store import read_store, write_store

    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("cpgspark").getOrCreate()
    if a.command == "convert":
        obs = readers.read_samplesheet(spark, a.sheet, a.treatment, a.control_group)
        ensure_converted(spark, obs, a.out, a.format, canonical_only=a.canonical_only)
        return
    if a.command == "annotate":
        genes, exons, utr = readers.read_gtf(spark, a.gtf)
        annotate.annotate_features(spark.read.parquet(a.sites), annotate.feature_table(genes, exons, utr), genes).write.parquet(a.out)
        return
    store = read_store(spark, a.store)
    if a.command == "filter":
        write_store(filter_sites(store, a.min_coverage, a.quantile), a.out)
    elif a.command == "summary":
        sample_summary(store).write.parquet(a.out)
    elif a.command in ("dmc", "dmr", "dvc"):
        check_groups(a.case, a.control, a.single)
        if a.command == "dvc":
            site_tests.variance_test(store, a.case, a.control, a.alpha).write.parquet(a.out)
            return
        obs = spark.createDataFrame([(s, 1) for s in a.case] + [(s, 0) for s in a.control], "sample_id string, treatment int")
        if a.sheet:
            obs = obs.join(spark.read.csv(a.sheet, header=True).drop("treatment"), "sample_id")
        names = {"command", "store", "out", "case", "control", "single", "sheet"}
        options = {k: v for k, v in vars(a).items() if k not in names} | {"allow_single": a.single}
        (site_tests.dmc if a.command == "dmc" else calls.dmr)(store, obs, **options).write.parquet(a.out)
    elif a.command == "report":
        at = lambda path: spark.read.parquet(path) if path else None
        report.write_report(a.title, report.sections(store, at(a.sites), at(a.regions)), a.out)
    elif a.command == "qc-report":
        qc.coverage_uniformity(store).write.parquet(a.out)
    elif a.command == "smooth":
        smooth.smooth(store, a.method, a.bandwidth).write.parquet(a.out)
    elif a.command == "aggregate-regions":
        aggregate_regions(store, readers.read_bed(spark, a.bed)).write.parquet(a.out)
    elif a.command == "export":
        writers.write_bedgraph(store, a.sample, a.out, a.value)


if __name__ == "__main__":
    main()

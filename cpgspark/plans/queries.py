"""Registered queries and their SQL.

The driver's tables hold no methylation data, so the queries run on the store
made of line items (sources.store.lineitem_store), with genes, regions and
islands made of parts.  The queries named ..._p, tile_calls and variance_test
compare the operators' own p values, whose tails SQL sums as series.  Behind
`sites()` p values are exp(-lr/2), the tail of a chi-squared variable with two
degrees of freedom, which both sides get to the last digits, so that thresholds
can't part them; everything downstream treats them as any other p value.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, align, annotate, fdr, glm, intervals, plotdata, prep, qc, reads, regions, segment, site_tests, smooth
from ..sources import store as st
from ..sources import writers
from ..sources.store import CONTROLS, TREATED, lineitem_store

ALL = [*TREATED, *CONTROLS]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(*names: str) -> list:
    """Doubles rounded as the SQL does; -0 becomes 0."""
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


def big(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- shared inputs ---------------------------------------------------------


def store(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_store(spark, d)


#: Set while a query makes its genes, regions and clock sites of all parts, not only of those that its SQL names.
WHOLE: ContextVar[bool] = ContextVar("whole", default=False)


def parts(spark: SparkSession, d: str, step: int) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p if WHOLE.get() else p.filter(f"p_partkey % {step} = 0")


def whole(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        token = WHOLE.set(True)
        try:
            return f(spark, d)
        finally:
            WHOLE.reset(token)

    return run


def genes(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d, 50)
    start = F.expr("(p_partkey div 5) * 100 + 37")
    return p.select(F.expr("concat('chr', (p_partkey div 50) % 5 + 1)").alias("chrom"), start.alias("start"), (start + 400 + F.col("p_size") * 40).alias("end"), F.expr("if(p_partkey % 100 = 0, '+', '-')").alias("strand"), F.expr("lpad(cast(p_partkey as string), 8, '0')").alias("gene_id"), F.expr("if(p_partkey % 150 = 0, 'lncRNA', 'protein_coding')").alias("gene_type"))


def exons(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d)
    e = g.withColumn("k", F.explode(F.expr("sequence(0, 2)")))
    size = F.expr("(end - start) div 5")
    return e.select("chrom", (F.col("start") + F.col("k") * 2 * size).alias("start"), (F.col("start") + (F.col("k") * 2 + 1) * size).alias("end"), "strand", "gene_id")


def beds(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d, 7)
    start = F.expr("(p_partkey div 5) * 100")
    return p.select(F.expr("concat('chr', p_partkey % 5 + 1)").alias("chrom"), start.alias("start"), (start + 50 + F.col("p_size") * 10).alias("end"), F.col("p_partkey").cast("string").alias("region_id"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """LR results (intersect, dispersion by site) with p = exp(-lr/2) and BH q."""
    s = site_tests.lr_statistic(aggregate.site_groups(store(spark, d), TREATED, CONTROLS, "intersect"), "site")
    s = s.withColumns({"pvalue": F.round(F.exp(-F.round("lr", 9) / 2), 12), "meth_diff": F.round("meth_diff", 9)})
    return s


STORE = """store AS (
  SELECT 's'||(l_suppkey%6) AS sample, 'chr'||(l_partkey%5+1) AS chrom, (l_partkey//5)*100+(l_partkey%7)*13 AS pos, '+' AS strand, 'CpG' AS context,
         sum(CAST(l_quantity AS INT))::BIGINT AS coverage,
         sum(CASE WHEN l_returnflag='R' OR (l_returnflag='A' AND l_suppkey%6<3 AND (l_partkey//5)%50<10) THEN CAST(l_quantity AS INT) ELSE 0 END)::BIGINT AS n_meth
  FROM lineitem GROUP BY ALL)"""
GROUPS = """grp AS (
  SELECT chrom, pos, count(DISTINCT sample) AS ns,
    sum(CASE WHEN sample IN ('s0','s1','s2') THEN coverage ELSE 0 END)::DOUBLE AS na, sum(CASE WHEN sample IN ('s0','s1','s2') THEN n_meth ELSE 0 END)::DOUBLE AS ma,
    coalesce(sum(CASE WHEN sample IN ('s0','s1','s2') THEN n_meth::DOUBLE*n_meth/coverage END),0) AS qa, count(CASE WHEN sample IN ('s0','s1','s2') THEN 1 END) AS ka,
    sum(CASE WHEN sample IN ('s3','s4','s5') THEN coverage ELSE 0 END)::DOUBLE AS nb, sum(CASE WHEN sample IN ('s3','s4','s5') THEN n_meth ELSE 0 END)::DOUBLE AS mb,
    coalesce(sum(CASE WHEN sample IN ('s3','s4','s5') THEN n_meth::DOUBLE*n_meth/coverage END),0) AS qb, count(CASE WHEN sample IN ('s3','s4','s5') THEN 1 END) AS kb
  FROM store WHERE coverage > 0 GROUP BY chrom, pos)"""
LR = """inf AS (
  SELECT *, (na>0 AND ma>0 AND ma<na AND nb>0 AND mb>0 AND mb<nb) AS i,
    CASE WHEN ma*(na-ma)>0 THEN (qa-ma*ma/na)/(ma*(na-ma)/(na*na)) ELSE 0 END + CASE WHEN mb*(nb-mb)>0 THEN (qb-mb*mb/nb)/(mb*(nb-mb)/(nb*nb)) ELSE 0 END AS x,
    ka+kb-2 AS df FROM grp WHERE ns=6),
phi AS (SELECT *, CASE WHEN i THEN greatest(1.0, x/CASE WHEN df>0 THEN df ELSE 1 END) ELSE 1.0 END AS phi FROM inf),
prob AS (SELECT *, least(greatest(ma/na,1e-6),1-1e-6) AS pa, least(greatest(mb/nb,1e-6),1-1e-6) AS pb, least(greatest((ma+mb)/(na+nb),1e-6),1-1e-6) AS p0 FROM phi),
lrs AS (SELECT chrom, pos, na, ma, nb, mb, ka, kb, df, phi, ma/na AS ba, mb/nb AS bb, ma/na-mb/nb AS diff,
    CASE WHEN ma+mb>0 AND ma+mb<na+nb THEN greatest(0, 2*(ma*ln(pa/p0)+(na-ma)*ln((1-pa)/(1-p0))+mb*ln(pb/p0)+(nb-mb)*ln((1-pb)/(1-p0)))/phi) END AS lr FROM prob)"""
SITES = """sites AS (SELECT chrom, pos, round(diff,9) AS d, round(exp(-round(lr,9)/2),12) AS p, ba, bb, phi, lr FROM lrs)"""
BED = """bed AS (SELECT 'chr'||(p_partkey%5+1) AS chrom, (p_partkey//5)*100 AS s, (p_partkey//5)*100+50+p_size*10 AS e, p_partkey::VARCHAR AS id FROM part WHERE p_partkey%7=0)"""
GENES = """genes AS (SELECT 'chr'||((p_partkey//50)%5+1) AS chrom, (p_partkey//5)*100+37 AS s, (p_partkey//5)*100+37+400+p_size*40 AS e, CASE WHEN p_partkey%100=0 THEN '+' ELSE '-' END AS strand,
  lpad(p_partkey::VARCHAR,8,'0') AS gene, CASE WHEN p_partkey%150=0 THEN 'lncRNA' ELSE 'protein_coding' END AS kind FROM part WHERE p_partkey%50=0)"""
BH = """ranked AS (SELECT *, p*count(*) OVER ()/count(*) OVER (ORDER BY p) AS raw FROM sites WHERE p IS NOT NULL),
bh AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC)) AS q FROM ranked)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def rd(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"round({e},6)+0.0 AS {n}" for e, n in pairs)


# ---- store and preprocessing ------------------------------------------------


@query("store_view", with_(STORE) + "SELECT sample, chrom, pos, n_meth, coverage FROM store")
def _(spark, d):
    return store(spark, d).select("sample", "chrom", *big("pos"), F.col("N_meth").cast("long").alias("n_meth"), *big("coverage"))


@query("query_region", with_(STORE) + f"SELECT sample, pos, n_meth, coverage, {rd(('n_meth/coverage', 'beta'))} FROM store WHERE chrom='chr2' AND pos>=1000 AND pos<20000 AND sample IN ('s0','s3')")
def _(spark, d):
    return st.query_region(store(spark, d), "chr2", 1000, 20000, ["s0", "s3"]).select("sample", *big("pos"), F.col("N_meth").cast("long").alias("n_meth"), *big("coverage"), *r6("beta"))


@query("query_regions", with_(STORE, BED) + "SELECT id AS region_id, sample, pos, coverage FROM store JOIN bed ON store.chrom=bed.chrom AND pos>=s AND pos<e WHERE sample='s1'")
def _(spark, d):
    return st.query_regions(store(spark, d), beds(spark, d), ["s1"]).select("region_id", "sample", *big("pos", "coverage"))


@query("query_sites", with_(STORE) + "SELECT sample, chrom, pos, coverage FROM store WHERE (chrom,pos) IN (SELECT 'chr'||(p_partkey%5+1), (p_partkey//5)*100+(p_partkey%7)*13 FROM part WHERE p_size=7)")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").filter("p_size = 7").select(F.expr("concat('chr', p_partkey % 5 + 1)").alias("chrom"), F.expr("int((p_partkey div 5) * 100 + (p_partkey % 7) * 13)").alias("pos"))
    return st.query_sites(store(spark, d), p).select("sample", "chrom", *big("pos", "coverage"))


@query("region_beta", with_(STORE) + f"SELECT sample, {rd(('sum(n_meth)/sum(coverage)', 'beta'), ('avg(coverage)', 'mean_coverage'))}, count(*) AS n_sites FROM store WHERE chrom='chr1' AND pos BETWEEN 5000 AND 15000 GROUP BY sample")
def _(spark, d):
    names = spark.createDataFrame([(s,) for s in ALL], "sample string")
    return st.region_beta(store(spark, d), names, "chr1", 5000, 15000).select("sample", *r6("beta", "mean_coverage"), *big("n_sites"))


@query("load_chromosome", with_(STORE) + "SELECT sample, pos, n_meth FROM store WHERE chrom='chr3' AND sample IN ('s2','s5') AND pos IN (SELECT pos FROM store WHERE chrom='chr3' GROUP BY pos HAVING count(DISTINCT sample)=6)")
def _(spark, d):
    s = store(spark, d)
    return st.load_chromosome(s, "chr3", ["s2", "s5"], align.intersect_sites(s, ALL)).select("sample", *big("pos"), F.col("N_meth").cast("long").alias("n_meth"))


@query("aligned_samples", with_(STORE) + ", u AS (SELECT DISTINCT chrom, pos FROM store), n AS (SELECT unnest(['s0','s3']) AS sample) SELECT n.sample, u.chrom, u.pos, coalesce(coverage,0) AS coverage FROM u CROSS JOIN n LEFT JOIN store USING (sample, chrom, pos)")
def _(spark, d):
    s = store(spark, d)
    return st.aligned(s, align.union_sites(s, ALL), ["s0", "s3"]).select("sample", "chrom", *big("pos", "coverage"))


@query("coverage_quantile", with_(STORE) + "SELECT sample, max(c) AS cutoff FROM (SELECT sample, coverage AS c, row_number() OVER (PARTITION BY sample ORDER BY coverage)-1 AS i, count(*) OVER (PARTITION BY sample) AS n FROM store) WHERE i = floor(0.99*(n-1)+0.5) GROUP BY sample")
def _(spark, d):
    return prep.coverage_quantile(store(spark, d), 0.99).select("sample", *big("cutoff"))


FILTERED = """cut AS (SELECT sample AS cs, max(c) AS cutoff FROM (SELECT sample, coverage AS c, row_number() OVER (PARTITION BY sample ORDER BY coverage)-1 AS i, count(*) OVER (PARTITION BY sample) AS n FROM store) WHERE i = floor(0.99*(n-1)+0.5) GROUP BY sample)"""


@query("filter_sites", with_(STORE, FILTERED, BED) + "SELECT sample, chrom, pos, coverage FROM store JOIN cut ON sample=cs WHERE coverage>=60 AND coverage<=cutoff AND NOT EXISTS (SELECT 1 FROM bed WHERE bed.chrom=store.chrom AND pos>=s AND pos<e)")
def _(spark, d):
    return prep.filter_sites(store(spark, d), 60, 0.99, beds(spark, d)).select("sample", "chrom", *big("pos", "coverage"))


@query("blacklist", with_(STORE, BED) + "SELECT sample, chrom, pos FROM store WHERE NOT EXISTS (SELECT 1 FROM bed WHERE bed.chrom=store.chrom AND pos>=s AND pos<e)")
def _(spark, d):
    return prep.drop_blacklisted(store(spark, d), beds(spark, d)).select("sample", "chrom", *big("pos"))


@query("normalize_coverage", with_(STORE) + ", c AS (SELECT sample AS cs, median(coverage) AS m FROM store GROUP BY sample), t AS (SELECT median(m) AS t FROM c) SELECT sample, chrom, pos, round(n_meth*(t/m))::BIGINT AS n_meth, (round(n_meth*(t/m))+round((coverage-n_meth)*(t/m)))::BIGINT AS coverage FROM store JOIN c ON sample=cs, t")
def _(spark, d):
    return prep.normalize_coverage(store(spark, d)).select("sample", "chrom", *big("pos"), F.col("N_meth").cast("long").alias("n_meth"), *big("coverage"))


@query("filter_canonical", with_(STORE) + "SELECT chrom, count(*) AS n FROM store WHERE chrom IN ('chr1','chr2','chr3','chr4','chr5') GROUP BY chrom")
def _(spark, d):
    return prep.filter_canonical(store(spark, d)).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("merge_strands", with_(STORE) + ", x AS (SELECT sample, chrom, CASE WHEN pos%2=1 THEN pos-1 ELSE pos END AS pos, n_meth, coverage FROM store) SELECT sample, chrom, pos, sum(n_meth)::BIGINT AS n_meth, sum(coverage)::BIGINT AS coverage FROM x GROUP BY ALL")
def _(spark, d):
    s = store(spark, d).withColumn("strand", F.expr("if(pos % 2 = 1, '-', '+')"))
    return prep.merge_strands(s).select("sample", "chrom", *big("pos"), F.col("N_meth").cast("long").alias("n_meth"), *big("coverage"))


@query("merge_pairs", with_(STORE) + """, x AS (SELECT sample, chrom, pos//100 AS pos, sum(n_meth) AS m, sum(coverage) AS c FROM store GROUP BY ALL),
 r AS (SELECT *, pos - row_number() OVER (PARTITION BY sample, chrom ORDER BY pos) AS run FROM x), k AS (SELECT *, (row_number() OVER (PARTITION BY sample, chrom, run ORDER BY pos)-1)//2 AS pair FROM r)
 SELECT sample, chrom, min(pos) AS pos, sum(m)::BIGINT AS n_meth, sum(c)::BIGINT AS coverage, count(*)=2 AS paired FROM k GROUP BY sample, chrom, run, pair""")
def _(spark, d):
    s = store(spark, d).withColumn("pos", F.expr("int(pos div 100)"))
    return prep.merge_pairs_by_position(s).select("sample", "chrom", *big("pos"), F.col("N_meth").cast("long").alias("n_meth"), *big("coverage"), (F.col("strand") == "+").alias("paired"))


@query("aggregate_regions", with_(STORE, BED) + "SELECT sample, store.chrom, id AS region_id, sum(n_meth)::BIGINT AS n_meth, sum(coverage)::BIGINT AS coverage, count(*) AS n_cpgs, (s+e)//2 AS pos FROM store JOIN bed ON store.chrom=bed.chrom AND pos>=s AND pos<e GROUP BY sample, store.chrom, id, s, e HAVING count(*)>=2")
def _(spark, d):
    return prep.aggregate_regions(store(spark, d), beds(spark, d), 2).select("sample", "chrom", "region_id", F.col("N_meth").cast("long").alias("n_meth"), *big("coverage", "n_cpgs", "pos"))


@query("tiles", with_(STORE) + "SELECT sample, chrom, pos//1000*1000 AS tile, sum(n_meth)::BIGINT AS n_meth, sum(coverage)::BIGINT AS coverage, count(*) AS n_cpgs FROM store GROUP BY ALL")
def _(spark, d):
    return prep.tiles(store(spark, d)).select("sample", "chrom", *big("tile"), F.col("N_meth").cast("long").alias("n_meth"), *big("coverage", "n_cpgs"))


@query("pseudo_counts", with_(STORE) + ", b AS (SELECT *, avg(n_meth/coverage) OVER (PARTITION BY sample, chrom ORDER BY pos RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS v FROM store) SELECT sample, chrom, pos, least(greatest(round_even(round(v,9)*coverage,0),0),coverage)::BIGINT AS n_meth FROM b")
def _(spark, d):
    from pyspark.sql import Window

    s = store(spark, d)
    w = Window.partitionBy("sample", "chrom").orderBy("pos").rangeBetween(-300, 300)
    sm = s.select("sample", "chrom", "pos", F.round(F.avg(F.col("N_meth") / F.col("coverage")).over(w), 9).alias("beta_smooth"))
    return prep.pseudo_counts(s, sm).select("sample", "chrom", *big("pos"), F.col("N_meth").cast("long").alias("n_meth"))


@query("position_runs", with_(STORE) + ", u AS (SELECT DISTINCT chrom, pos FROM store), l AS (SELECT *, CASE WHEN pos-lag(pos) OVER w<=100 THEN 0 ELSE 1 END AS b FROM u WINDOW w AS (PARTITION BY chrom ORDER BY pos)), i AS (SELECT *, sum(b) OVER (PARTITION BY chrom ORDER BY pos) AS id FROM l) SELECT chrom, min(pos) AS start, max(pos)+1 AS \"end\", count(*) AS n FROM i GROUP BY chrom, id")
def _(spark, d):
    return prep.runs(store(spark, d), ["chrom"], 100).select("chrom", *big("start", "end", "n"))


# ---- alignment and aggregation ----------------------------------------------


@query("intersect_sites", with_(STORE) + "SELECT chrom, pos, '+' AS strand FROM store GROUP BY chrom, pos HAVING count(DISTINCT sample)=6")
def _(spark, d):
    return align.intersect_sites(store(spark, d), ALL).select("chrom", *big("pos"), "strand")


@query("union_sites", with_(STORE) + "SELECT chrom, pos, '+' AS strand FROM store GROUP BY chrom, pos")
def _(spark, d):
    return align.union_sites(store(spark, d), ALL).select("chrom", *big("pos"), "strand")


@query("intersect_stranded", with_(STORE) + "SELECT chrom, pos, strand FROM store GROUP BY chrom, pos, strand HAVING count(DISTINCT sample)=6")
def _(spark, d):
    return align.intersect_stranded(store(spark, d), ALL).select("chrom", *big("pos"), "strand")


@query("site_index", with_(STORE) + "SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos)-1 AS idx FROM (SELECT DISTINCT chrom, pos FROM store)")
def _(spark, d):
    return align.site_index(store(spark, d), ALL).select("chrom", *big("pos"), F.col("index").cast("long").alias("idx"))


@query("sample_summary", with_(STORE) + f"SELECT sample, chrom, count(*) AS n_sites, {rd(('avg(coverage)', 'mean_coverage'), ('median(coverage)', 'median_coverage'), ('sum(n_meth)/sum(coverage)', 'pooled_methylation'))} FROM store GROUP BY sample, chrom")
def _(spark, d):
    return aggregate.sample_summary(store(spark, d)).select("sample", "chrom", *big("n_sites"), *r6("mean_coverage", "median_coverage", "pooled_methylation"))


@query("site_groups", with_(STORE, GROUPS) + f"SELECT chrom, pos, na::BIGINT AS n_case, ma::BIGINT AS m_case, ka AS k_case, nb::BIGINT AS n_ctrl, mb::BIGINT AS m_ctrl, kb AS k_ctrl, {rd(('qa', 'q_case'), ('qb', 'q_ctrl'))} FROM grp")
def _(spark, d):
    return aggregate.site_groups(store(spark, d), TREATED, CONTROLS).select("chrom", *big("pos", "n_case", "m_case", "k_case", "n_ctrl", "m_ctrl", "k_ctrl"), *r6("q_case", "q_ctrl"))


@query("welford", with_(STORE) + f"SELECT chrom, pos, count(*) AS n, {rd(('avg(n_meth/coverage)', 'mean'), ('coalesce(var_samp(n_meth/coverage)*(count(*)-1),0)', 'm2'), ('var_samp(n_meth/coverage)/count(*)', 'var_mean'))} FROM store WHERE sample IN ('s0','s1','s2') AND coverage>0 GROUP BY chrom, pos")
def _(spark, d):
    return aggregate.welford(store(spark, d), TREATED).select("chrom", *big("pos", "n"), *r6("mean", "m2", "var_mean"))


# ---- site tests -------------------------------------------------------------


@query("site_lr", with_(STORE, GROUPS, LR) + f"SELECT chrom, pos, {rd(('diff', 'meth_diff'), ('phi', 'phi'), ('lr', 'lr'))} FROM lrs")
def _(spark, d):
    g = aggregate.site_groups(store(spark, d), TREATED, CONTROLS, "intersect")
    return site_tests.lr_statistic(g, "site").select("chrom", *big("pos"), *r6("meth_diff", "phi", "lr"))


EB = """c AS (SELECT chrom AS cc, count(*) FILTER (i) AS sites, sum(x) FILTER (i) AS sx, sum(ka+kb) FILTER (i) AS k, avg(phi) FILTER (i AND df>0) AS mu, var_pop(phi) FILTER (i AND df>0) AS v FROM phi GROUP BY chrom),
c2 AS (SELECT cc, CASE WHEN sites>=100 THEN greatest(1.0, sx/greatest(k-2*sites,1)) ELSE 1.0 END AS pc, CASE WHEN v>0 AND mu>0 THEN greatest(1.0, 2*(mu*mu/v+2)) ELSE 4.0 END AS w FROM c)"""


@query("site_dispersion_eb", with_(STORE, GROUPS, LR, EB) + f"SELECT chrom, pos, {rd(('CASE WHEN i AND df>0 THEN greatest(1.0,(df*phi+w*pc)/(df+w)) ELSE greatest(1.0,pc) END', 'phi'))} FROM phi JOIN c2 ON chrom=cc")
def _(spark, d):
    g = aggregate.site_groups(store(spark, d), TREATED, CONTROLS, "intersect")
    return site_tests.dispersions(g, "eb").select("chrom", *big("pos"), *r6("phi"))


@query("site_dispersion_shrink", with_(STORE, GROUPS, LR, EB) + f"SELECT chrom, pos, {rd(('CASE WHEN i AND df>0 THEN greatest(1.0,(df*phi+4.0*pc)/(df+4.0)) ELSE greatest(1.0,pc) END', 'phi'))} FROM phi JOIN c2 ON chrom=cc")
def _(spark, d):
    g = aggregate.site_groups(store(spark, d), TREATED, CONTROLS, "intersect")
    return site_tests.dispersions(g, "shrink").select("chrom", *big("pos"), *r6("phi"))


@query("site_dispersion_chrom", with_(STORE, GROUPS, LR, EB) + f"SELECT chrom, pos, {rd(('pc', 'phi'))} FROM phi JOIN c2 ON chrom=cc")
def _(spark, d):
    g = aggregate.site_groups(store(spark, d), TREATED, CONTROLS, "intersect")
    return site_tests.dispersions(g, "chrom").select("chrom", *big("pos"), *r6("phi"))


def chi1_sql(x: str) -> str:
    """Upper tail of chi-squared with one degree of freedom: one minus the series of the error function."""
    z = f"least(sqrt({x}/2), 6.0)"
    return f"(CASE WHEN {x}<=0 THEN 1.0 ELSE greatest(0.0, 1-list_sum(list_transform(range(0,160), lambda term: exp((2*term+1)*ln({z})-{z}*{z}-lgamma(term+1.5))))) END)"


def beta_sql(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta function by its series of positive terms, from the end where it converges fast."""
    series = lambda a, b, x: f"list_sum(list_transform(range(0,1500), lambda term: exp(({a}+term)*ln({x})+({b})*ln(1-({x}))+lgamma({a}+{b}+term)-lgamma({a}+1+term)-lgamma({b}))))"
    return f"(CASE WHEN {x}<=0 THEN 0.0 WHEN {x}>=1 THEN 1.0 WHEN {x}<0.75 THEN {series(a, b, x)} ELSE 1-{series(b, a, f'(1-{x})')} END)"


def f1_sql(x: str, df: str) -> str:
    """Upper tail of F with 1 and df degrees, and of a two-sided t whose square is x."""
    return beta_sql(f"({df}/2)", "0.5", f"({df}/({df}+{x}))")


#: The likelihood-ratio test as it is by default: drawn dispersions, F where they exceed 1.
LR_P = """c3 AS (SELECT cc AS c3c, CASE WHEN sites>=100 THEN greatest(k-2*sites,1) ELSE 1.0 END AS dc FROM c),
eb AS (SELECT phi.chrom, phi.pos, CASE WHEN i AND df>0 THEN greatest(1.0,(df*phi+w*pc)/(df+w)) ELSE greatest(1.0,pc) END AS f, CASE WHEN i AND df>0 THEN df+w ELSE dc END AS fd FROM phi JOIN c2 ON chrom=cc JOIN c3 ON chrom=c3c),
st AS (SELECT eb.chrom, eb.pos, f, greatest(fd,50.0)::DOUBLE AS fd, lr*phi/f AS x FROM lrs JOIN eb ON eb.chrom=lrs.chrom AND eb.pos=lrs.pos)"""


@query("site_lr_p", with_(STORE, GROUPS, LR, EB, LR_P) + f"SELECT chrom, pos, {rd(('x', 'lr'))}, round(CASE WHEN f>1 THEN {f1_sql('x', 'fd')} ELSE {chi1_sql('x')} END, 6)+0.0 AS pvalue FROM st")
def _(spark, d):
    return site_tests.lr_test(store(spark, d), TREATED, CONTROLS, site_tests.TestConfig(unite="intersect")).select("chrom", *big("pos"), *r6("lr", "pvalue"))


@query("site_test_full")
def _(spark, d):
    return site_tests.test_sites(store(spark, d), TREATED, CONTROLS, site_tests.TestConfig(power_stack=True, unite="intersect"))


@query("site_welch", with_(STORE) + """, g AS (SELECT chrom, pos, count(*) FILTER (sample<'s3') AS ka, count(*) FILTER (sample>='s3') AS kb, avg(n_meth/coverage) FILTER (sample<'s3') AS a, avg(n_meth/coverage) FILTER (sample>='s3') AS b,
 var_samp(n_meth/coverage) FILTER (sample<'s3') AS va, var_samp(n_meth/coverage) FILTER (sample>='s3') AS vb FROM store WHERE coverage>0 GROUP BY chrom, pos HAVING count(*)=6)
 SELECT chrom, pos, """ + rd(("a-b", "meth_diff"), ("CASE WHEN va+vb>0 THEN (a-b)/sqrt(va/ka+vb/kb) END", "t"), ("CASE WHEN va+vb>0 THEN greatest(1.0,(va/ka+vb/kb)*(va/ka+vb/kb)/((va/ka)*(va/ka)/(ka-1)+(vb/kb)*(vb/kb)/(kb-1))) END", "dof")) + " FROM g")
def _(spark, d):
    g = aggregate.site_groups(store(spark, d), TREATED, CONTROLS, "intersect")
    return site_tests.welch_statistic(g).select("chrom", *big("pos"), *r6("meth_diff", "t", "dof"))


WELCH = """g AS (SELECT chrom, pos, count(*) FILTER (sample<'s3') AS ka, count(*) FILTER (sample>='s3') AS kb, avg(n_meth/coverage) FILTER (sample<'s3') AS a, avg(n_meth/coverage) FILTER (sample>='s3') AS b,
 var_samp(n_meth/coverage) FILTER (sample<'s3') AS va, var_samp(n_meth/coverage) FILTER (sample>='s3') AS vb FROM store WHERE coverage>0 GROUP BY chrom, pos HAVING count(*)=6),
wt AS (SELECT chrom, pos, CASE WHEN va+vb>0 THEN (a-b)*(a-b)/(va/ka+vb/kb) END AS t2, CASE WHEN va+vb>0 THEN greatest(1.0,(va/ka+vb/kb)*(va/ka+vb/kb)/((va/ka)*(va/ka)/(ka-1)+(vb/kb)*(vb/kb)/(kb-1))) END AS v FROM g)"""


@query("site_welch_p", with_(STORE, WELCH) + f"SELECT chrom, pos, round(CASE WHEN t2 IS NOT NULL THEN {f1_sql('t2', 'v')} END, 6)+0.0 AS pvalue FROM wt")
def _(spark, d):
    return site_tests.welch_test(store(spark, d), TREATED, CONTROLS, site_tests.TestConfig(test="welch_t", unite="intersect")).select("chrom", *big("pos"), *r6("pvalue"))


@query("site_welch_full")
def _(spark, d):
    return site_tests.welch_test(store(spark, d), TREATED, CONTROLS, site_tests.TestConfig(test="welch_t", unite="intersect"))


FISHER = """f AS (SELECT chrom, pos, ma::BIGINT AS a, na::BIGINT AS ra, (ma+mb)::BIGINT AS m, nb::BIGINT AS rb, (na+nb)::BIGINT AS n FROM grp WHERE ns=6),
k AS (SELECT *, unnest(range(greatest(0, m-rb), least(ra, m)+1)) AS x FROM f),
lp AS (SELECT *, lgamma(ra+1)-lgamma(x+1)-lgamma(ra-x+1)+lgamma(rb+1)-lgamma(m-x+1)-lgamma(rb-m+x+1)-lgamma(n+1)+lgamma(m+1)+lgamma(n-m+1) AS l FROM k),
o AS (SELECT *, exp(l) AS pmf, max(CASE WHEN x=a THEN exp(l) END) OVER (PARTITION BY chrom, pos) AS po FROM lp)"""


@query("site_fisher", with_(STORE, GROUPS, FISHER) + "SELECT chrom, pos, round(CASE WHEN any_value(m) IN (0, any_value(n)) THEN 1.0 ELSE least(1.0, sum(CASE WHEN pmf<=po*(1+1e-7)+1e-15 THEN pmf ELSE 0 END)) END, 6)+0.0 AS pvalue FROM o GROUP BY chrom, pos")
def _(spark, d):
    return site_tests.fisher_test(store(spark, d), TREATED, CONTROLS, site_tests.TestConfig(test="fisher", unite="intersect")).select("chrom", *big("pos"), *r6("pvalue"))


NEWCOMBE = """nw AS (SELECT chrom, pos, ma/na AS p1, mb/nb AS p2, na, nb, 1.959963984540054 AS z FROM grp WHERE ns=6),
wl AS (SELECT *, (p1+z*z/(2*na)-z*sqrt(p1*(1-p1)/na+z*z/(4*na*na)))/(1+z*z/na) AS l1, (p1+z*z/(2*na)+z*sqrt(p1*(1-p1)/na+z*z/(4*na*na)))/(1+z*z/na) AS u1,
 (p2+z*z/(2*nb)-z*sqrt(p2*(1-p2)/nb+z*z/(4*nb*nb)))/(1+z*z/nb) AS l2, (p2+z*z/(2*nb)+z*sqrt(p2*(1-p2)/nb+z*z/(4*nb*nb)))/(1+z*z/nb) AS u2 FROM nw),
ci AS (SELECT chrom, pos, p1-p2 AS d, greatest(-1,p1-p2-sqrt((p1-l1)*(p1-l1)+(u2-p2)*(u2-p2))) AS lo, least(1,p1-p2+sqrt((u1-p1)*(u1-p1)+(p2-l2)*(p2-l2))) AS hi FROM wl)"""


def _ci(spark, d):
    g = site_tests.newcombe_interval(aggregate.site_groups(store(spark, d), TREATED, CONTROLS, "intersect"))
    return g.withColumn("meth_diff", F.col("m_case") / F.col("n_case") - F.col("m_ctrl") / F.col("n_ctrl"))


@query("newcombe_interval", with_(STORE, GROUPS, NEWCOMBE) + f"SELECT chrom, pos, {rd(('lo', 'ci_low'), ('hi', 'ci_high'))} FROM ci")
def _(spark, d):
    return _ci(spark, d).select("chrom", *big("pos"), *r6("ci_low", "ci_high"))


@query("shrink_effects", with_(STORE, GROUPS, NEWCOMBE) + ", se AS (SELECT *, (hi-lo)/(2*1.959963984540054) AS se FROM ci), t AS (SELECT greatest(0, var_samp(d)-avg(se*se)) AS tau FROM se) SELECT chrom, pos, round(CASE WHEN tau+se*se>0 THEN d*tau/(tau+se*se) ELSE 0 END, 6)+0.0 AS meth_diff_shrunk FROM se, t")
def _(spark, d):
    return site_tests.shrink_effects(_ci(spark, d)).select("chrom", *big("pos"), *r6("meth_diff_shrunk"))


BF = """b AS (SELECT chrom, pos, sample<'s3' AS cs, n_meth/coverage AS b FROM store WHERE coverage>0),
md AS (SELECT chrom, pos, cs, median(b) AS med, var_samp(b) AS v, count(*) AS n FROM b GROUP BY ALL),
z AS (SELECT b.chrom, b.pos, b.cs, any_value(n) AS n, any_value(v) AS v, avg(abs(b-med)) AS m, sum(abs(b-med)*abs(b-med)) AS q FROM b JOIN md ON b.chrom=md.chrom AND b.pos=md.pos AND b.cs=md.cs GROUP BY ALL),
w AS (SELECT a.chrom, a.pos, a.n AS na, c.n AS nb, a.m AS ma, c.m AS mb, a.v AS va, c.v AS vb, a.q-a.n*a.m*a.m+c.q-c.n*c.m*c.m AS within, (a.n*a.m+c.n*c.m)/(a.n+c.n) AS g FROM z a JOIN z c ON a.chrom=c.chrom AND a.pos=c.pos AND a.cs AND NOT c.cs WHERE a.n>=3 AND c.n>=3)"""


@query("variance_statistic", with_(STORE, BF) + f"SELECT chrom, pos, {rd(('CASE WHEN va>0 AND vb>0 THEN log2(va/vb) END', 'var_log_ratio'))}, round(CASE WHEN within>1e-15 THEN (na*(ma-g)*(ma-g)+nb*(mb-g)*(mb-g))/(within/(na+nb-2)) END, 4)+0.0 AS f_stat FROM w")
def _(spark, d):
    return site_tests.brown_forsythe(store(spark, d), TREATED, CONTROLS).select("chrom", *big("pos"), *r6("var_log_ratio"), (F.round("f_stat", 4) + F.lit(0.0)).alias("f_stat"))


@query("variance_test", with_(STORE, BF, WELCH) + f""", f AS (SELECT w.chrom, w.pos, CASE WHEN within>1e-15 THEN (na*(ma-g)*(ma-g)+nb*(mb-g)*(mb-g))/(within/(na+nb-2)) END AS x, (na+nb-2)::DOUBLE AS n2, t2, v FROM w JOIN wt ON w.chrom=wt.chrom AND w.pos=wt.pos)
 SELECT chrom, pos, round(CASE WHEN x IS NOT NULL THEN {f1_sql('x', 'n2')} END, 6)+0.0 AS pvalue_variance, round(CASE WHEN t2 IS NOT NULL THEN {f1_sql('t2', 'v')} END, 6)+0.0 AS pvalue_mean FROM f""")
def _(spark, d):
    """The sites that all samples cover, as the SQL's means are theirs."""
    s = store(spark, d)
    return site_tests.variance_test(s, TREATED, CONTROLS).select("chrom", *big("pos"), *r6("pvalue_variance", "pvalue_mean"))


@query("variance_test_full")
def _(spark, d):
    return site_tests.variance_test(store(spark, d), TREATED, CONTROLS)


@query("dmc_glm")
def _(spark, d):
    """The one entry: a model with a batch, drawn dispersions, adjusted differences."""
    obs = spark.createDataFrame([(s, int(s in TREATED), "ab"[i % 2]) for i, s in enumerate(ALL)], "sample_id string, treatment int, batch string")
    return site_tests.dmc(store(spark, d), obs, covariates=["batch"], dispersion="eb")


@query("dmc_auto")
def _(spark, d):
    """The one entry by default: likelihood ratio, drawn dispersions, interval and q values."""
    obs = spark.createDataFrame([(s, int(s in TREATED)) for s in ALL], "sample_id string, treatment int")
    return site_tests.dmc(store(spark, d), obs)


@query("glm_contrast")
def _(spark, d):
    import pandas as pd

    obs = pd.DataFrame({"sample_id": ALL, "treatment": [1, 1, 1, 0, 0, 0], "batch": ["a", "b", "a", "b", "a", "b"]})
    return glm.test_formula(store(spark, d), obs, "~ treatment + batch", "treatment")


@query("glm_deviance")
def _(spark, d):
    import pandas as pd

    obs = pd.DataFrame({"sample_id": ALL, "treatment": [1, 1, 1, 0, 0, 0]})
    return glm.test_formula(store(spark, d), obs, "~ treatment", drop="treatment")


# ---- multiple testing --------------------------------------------------------


@query("fdr_bh", with_(STORE, GROUPS, LR, SITES, BH) + "SELECT chrom, pos, round(q,6)+0.0 AS qvalue, q<=0.05 AS reject FROM bh UNION ALL SELECT chrom, pos, NULL, false FROM sites WHERE p IS NULL")
def _(spark, d):
    return fdr.adjust(sites(spark, d)).select("chrom", *big("pos"), *r6("qvalue"), "reject")


@query("fdr_by", with_(STORE, GROUPS, LR, SITES) + ", h AS (SELECT sum(1.0/i) AS h FROM (SELECT unnest(range(1, (SELECT count(*) FROM sites WHERE p IS NOT NULL)+1)) AS i)), r AS (SELECT *, p*h*count(*) OVER ()/count(*) OVER (ORDER BY p) AS raw FROM sites, h WHERE p IS NOT NULL) SELECT chrom, pos, round(least(1.0, min(raw) OVER (ORDER BY p DESC)),6)+0.0 AS qvalue FROM r")
def _(spark, d):
    return fdr.adjust(sites(spark, d), "fdr_by").filter("qvalue is not null").select("chrom", *big("pos"), *r6("qvalue"))


@query("fdr_storey", with_(STORE, GROUPS, LR, SITES) + ", pi AS (SELECT least(1.0, greatest(1.0/count(p), count(*) FILTER (p>0.5)/(0.5*count(p)))) AS pi0 FROM sites), r AS (SELECT *, p*pi0*count(*) OVER ()/count(*) OVER (ORDER BY p) AS raw FROM sites, pi WHERE p IS NOT NULL) SELECT chrom, pos, round(least(1.0, min(raw) OVER (ORDER BY p DESC)),6)+0.0 AS qvalue FROM r")
def _(spark, d):
    return fdr.adjust(sites(spark, d), "fdr_storey").filter("qvalue is not null").select("chrom", *big("pos"), *r6("qvalue"))


@query("fdr_two_stage", with_(STORE, GROUPS, LR, SITES, BH) + """, k AS (SELECT count(*) FILTER (q<=0.05/1.05) AS r, count(*) AS n FROM bh), m AS (SELECT CASE WHEN r>0 AND r<n THEN (n-r)/n ELSE 1.0 END*1.05 AS f FROM k),
 r2 AS (SELECT chrom, pos, p, raw*f AS raw2 FROM bh, m) SELECT chrom, pos, round(least(1.0, min(raw2) OVER (ORDER BY p DESC)),6)+0.0 AS qvalue FROM r2""")
def _(spark, d):
    return fdr.adjust(sites(spark, d), "fdr_tsbky").filter("qvalue is not null").select("chrom", *big("pos"), *r6("qvalue"))


@query("fdr_by_chrom", with_(STORE, GROUPS, LR, SITES) + ", r AS (SELECT *, p*count(*) OVER (PARTITION BY chrom)/count(*) OVER (PARTITION BY chrom ORDER BY p) AS raw FROM sites WHERE p IS NOT NULL) SELECT chrom, pos, round(least(1.0, min(raw) OVER (PARTITION BY chrom ORDER BY p DESC)),6)+0.0 AS qvalue FROM r")
def _(spark, d):
    return fdr.adjust_by_chrom(sites(spark, d)).filter("qvalue is not null").select("chrom", *big("pos"), *r6("qvalue"))


@query("permutation_sites")
def _(spark, d):
    s = store(spark, d)
    return fdr.empirical_site_fdr(s, TREATED, CONTROLS, sites(spark, d)).select("chrom", "pos", "lr", "p_empirical", "q_empirical")


@query("region_count_ratio", with_(STORE, GROUPS, LR, SITES) + ", o AS (SELECT chrom, pos, p FROM sites WHERE p IS NOT NULL AND abs(d)>=0.1), n AS (SELECT p FROM sites WHERE p IS NOT NULL AND abs(d)<0.1), c AS (SELECT chrom, pos, p, (SELECT count(*) FROM n WHERE n.p<=o.p)/10.0/count(*) OVER (ORDER BY p) AS raw FROM o) SELECT chrom, pos, round(least(1.0, min(raw) OVER (ORDER BY p DESC)),6)+0.0 AS q_empirical FROM c")
def _(spark, d):
    s = sites(spark, d).filter("pvalue is not null").select("chrom", "pos", "pvalue", "meth_diff")
    return fdr.region_count_ratio(s.filter("abs(meth_diff) >= 0.1"), s.filter("abs(meth_diff) < 0.1"), 10).select("chrom", *big("pos"), *r6("q_empirical"))


# ---- windows ------------------------------------------------------------------


@query("box_smooth", with_(STORE) + f"SELECT sample, chrom, pos, {rd(('avg(n_meth) OVER w', 'n_meth'), ('avg(coverage) OVER w', 'coverage'))} FROM store WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos RANGE BETWEEN 250 PRECEDING AND 250 FOLLOWING)")
def _(spark, d):
    return smooth.box_smooth(store(spark, d), 500).select("sample", "chrom", *big("pos"), (F.round("N_meth", 6) + F.lit(0.0)).alias("n_meth"), *r6("coverage"))


@query("neighbour_scores", with_(STORE, GROUPS, LR, SITES) + """, z AS (SELECT chrom, pos, CASE WHEN d>=0 THEN 1 ELSE 0 END AS up, CASE WHEN d>=0 THEN 1 ELSE -1 END*sqrt(round(lr,9)) AS z FROM sites WHERE lr IS NOT NULL),
 w AS (SELECT chrom, pos, up, count(*) OVER w AS n, sum(z) OVER w AS zs, sum(up) OVER w AS ups FROM z WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING))
 SELECT chrom, pos, n AS n_neighbours, """ + rd(("zs", "z_sum"), ("CASE WHEN up=1 THEN ups ELSE n-ups END/n", "sign_share")) + " FROM w")
def _(spark, d):
    s = sites(spark, d).filter("lr is not null").withColumn("z", F.when(F.col("meth_diff") >= 0, 1).otherwise(-1) * F.sqrt(F.round("lr", 9)))
    return smooth.neighbour_scores(s, 200).select("chrom", *big("pos", "n_neighbours"), *r6("z_sum", "sign_share"))


@query("combine_neighbours")
def _(spark, d):
    return smooth.combine_neighbours(sites(spark, d)).select("chrom", "pos", "pvalue", "pvalue_combined", "n_neighbours")


@query("smooth_gaussian")
def _(spark, d):
    return smooth.smooth(store(spark, d), bandwidth=500)


@query("smooth_polynomial")
def _(spark, d):
    return smooth.smooth(store(spark, d), "bsmooth", ns=20, h_bp=500)


@query("impute_knn")
def _(spark, d):
    s = store(spark, d)
    return smooth.impute(s, align.union_sites(s, ALL), ALL)


# ---- regions ------------------------------------------------------------------

#: A region's direction: of the mean, mixed where neither sign has 60 % of the sites that have one.
KIND = "CASE WHEN up+dn=0 OR greatest(up,dn)/(up+dn)<0.6 THEN 'mixed' WHEN mu>0 THEN 'hyper' ELSE 'hypo' END"


def chain_sql(alpha: float, diff: float, gap: int, cpgs: int, share: float, length: int) -> str:
    return f"""cs AS (SELECT *, coalesce(p<{alpha!r} AND abs(d)>={diff}, false) AS sig FROM sites),
l AS (SELECT *, last_value(CASE WHEN sig THEN pos END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls FROM cs),
b AS (SELECT *, sum(CASE WHEN sig AND (ls IS NULL OR pos-ls>{gap}) THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos) AS chain FROM l),
nx AS (SELECT *, first_value(CASE WHEN sig THEN chain END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nc FROM b),
reg AS (SELECT chrom, min(pos) AS s, max(pos)+1 AS e, count(*) AS n, sum(sig::INT) AS k, avg(d) AS mu, count(*) FILTER (d>0) AS up, count(*) FILTER (d<0) AS dn FROM nx WHERE chain>0 AND chain=nc GROUP BY chrom, chain),
chains AS (SELECT chrom, s, e, n, k, mu, {KIND} AS kind FROM reg WHERE e-s>={length} AND n>={cpgs} AND k/n>={share})"""


CHAIN = chain_sql(0.05, 0.1, 500, 3, 0.5, 50)
CHAIN_ROWS = f"SELECT chrom, s AS start, e AS \"end\", n AS n_cpgs, k::BIGINT AS n_sig, kind AS dmr_type, {rd(('mu', 'mean_diff'))} FROM chains"


def chains(spark, d, combine=False):
    return regions.chain_merge(sites(spark, d), min_cpgs=3, combine=combine)


def chain_rows(regions_):
    return regions_.select("chrom", *big("start", "end", "n_cpgs", "n_sig"), "dmr_type", *r6("mean_diff"))


@query("chain_merge", with_(STORE, GROUPS, LR, SITES, CHAIN) + CHAIN_ROWS)
def _(spark, d):
    return chain_rows(chains(spark, d))


# the values of the presets, said again
@query("chain_merge_strict", with_(STORE, GROUPS, LR, SITES, chain_sql(1e-6, 0.2, 250, 5, 0.5, 100)) + CHAIN_ROWS)
def _(spark, d):
    return chain_rows(regions.chain_merge(sites(spark, d), "strict", combine=False))


@query("chain_merge_default", with_(STORE, GROUPS, LR, SITES, chain_sql(1e-4, 0.1, 500, 3, 0.5, 50)) + CHAIN_ROWS)
def _(spark, d):
    return chain_rows(regions.chain_merge(sites(spark, d), "default", combine=False))


@query("chain_merge_permissive", with_(STORE, GROUPS, LR, SITES, chain_sql(1e-4, 0.05, 1000, 3, 0.5, 50)) + CHAIN_ROWS)
def _(spark, d):
    return chain_rows(regions.chain_merge(sites(spark, d), "permissive", combine=False))


@query("chain_merge_explicit", with_(STORE, GROUPS, LR, SITES, chain_sql(0.05, 0.05, 1000, 2, 0.5, 50)) + CHAIN_ROWS)
def _(spark, d):
    """What is given wins over the preset."""
    return chain_rows(regions.chain_merge(sites(spark, d), "permissive", alpha=0.05, min_cpgs=2, combine=False))


@query("chain_merge_full")
def _(spark, d):
    return prep.region_qfilter(chains(spark, d, True), 0.05, ("qvalue_combined",))


@query("sliding_windows", with_(STORE, GROUPS, LR, SITES) + """, cs AS (SELECT *, coalesce(p<0.05 AND abs(d)>=0.1, false) AS sig FROM sites),
 w AS (SELECT *, count(*) OVER w AS n, sum(sig::INT) OVER w AS k FROM cs WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 499 FOLLOWING)),
 c AS (SELECT chrom, pos, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS pv FROM w WHERE n>=3 AND k>=2),
 i AS (SELECT *, sum(CASE WHEN pv IS NULL OR pos-pv>500 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos) AS id FROM c),
 sp AS (SELECT chrom, min(pos) AS s, max(pos)+500 AS e FROM i GROUP BY chrom, id HAVING max(pos)+500-min(pos)<=10000)
 SELECT sp.chrom, s AS start, e AS "end", count(*) AS n_cpgs, sum(sig::INT)::BIGINT AS n_sig, round(avg(d),6)+0.0 AS mean_diff FROM sp JOIN cs ON cs.chrom=sp.chrom AND pos>=s AND pos<e GROUP BY sp.chrom, s, e HAVING count(*)>=3 AND sum(sig::INT)>=2""")
def _(spark, d):
    s = sites(spark, d)
    return regions.sliding_windows(s, min_cpgs=3, min_sig=2, combine=False).select("chrom", *big("start", "end", "n_cpgs", "n_sig"), *r6("mean_diff"))


TILES = """ts AS (SELECT sample, chrom, pos//1000*1000 AS pos, sum(n_meth) AS n_meth, sum(coverage) AS coverage, count(*) AS nc FROM store GROUP BY ALL)"""
TILE_GROUPS = GROUPS.replace("FROM store", "FROM ts").replace("count(DISTINCT sample) AS ns,", "count(DISTINCT sample) AS ns, max(nc) AS nc,")


def tiled(spark, d):
    return regions.tile_statistics(store(spark, d), TREATED, CONTROLS)


@query("tile_statistics", with_(STORE, TILES, TILE_GROUPS, LR) + f"SELECT chrom, pos AS start, {rd(('diff', 'meth_diff'), ('phi', 'phi'), ('lr', 'lr'))} FROM lrs JOIN (SELECT chrom AS c, pos AS t FROM grp WHERE nc>=5) ON c=chrom AND t=pos")
def _(spark, d):
    return tiled(spark, d).select("chrom", *big("start"), *r6("meth_diff", "phi", "lr"))


@query("merge_tiles", with_(STORE, TILES, TILE_GROUPS, LR) + """, t AS (SELECT chrom, pos AS s, pos+1000 AS e, nc, diff, CASE WHEN diff>=0 THEN 'hyper' ELSE 'hypo' END AS kind FROM lrs JOIN (SELECT chrom AS c, pos AS t, nc FROM grp WHERE nc>=5) ON c=chrom AND t=pos WHERE round(lr,6)>3.841459 AND abs(round(diff,9))>=0.1),
 g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s>pe OR kind<>pk THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s) AS id FROM (SELECT *, lag(e) OVER w AS pe, lag(kind) OVER w AS pk FROM t WINDOW w AS (PARTITION BY chrom ORDER BY s)))
 SELECT chrom, min(s) AS start, max(e) AS "end", any_value(kind) AS dmr_type, sum(nc)::BIGINT AS n_cpgs, round(avg(diff),6)+0.0 AS meth_diff, count(*) AS n_tiles FROM g GROUP BY chrom, id""")
def _(spark, d):
    t = tiled(spark, d).filter((F.round("lr", 6) > 3.841459) & (F.abs(F.round("meth_diff", 9)) >= 0.1)).withColumn("dmr_type", F.when(F.col("meth_diff") >= 0, "hyper").otherwise("hypo"))
    return regions.merge_adjacent_tiles(t, combine=False).select("chrom", *big("start", "end"), "dmr_type", *big("n_cpgs"), *r6("meth_diff"), *big("n_tiles"))


@query("tile_calls", with_(STORE, TILES, TILE_GROUPS, LR) + f""", sites AS (SELECT lrs.chrom, lrs.pos, diff AS d, round({chi1_sql('lr')},9) AS p FROM lrs JOIN (SELECT chrom AS c, pos AS t FROM grp WHERE nc>=5) ON c=chrom AND t=pos), {BH}
 SELECT chrom, pos AS start, round(p,6)+0.0 AS pvalue, round(q,6)+0.0 AS qvalue, CASE WHEN d>=0 THEN 'hyper' ELSE 'hypo' END AS dmr_type FROM bh WHERE q<0.05 AND abs(d)>=0.1""")
def _(spark, d):
    """The operator's own p values, cut to nine digits before the q values on both sides, and tiles unmerged."""
    s = tiled(spark, d)
    s = s.withColumn("pvalue", F.round(site_tests.reference_p(F.col("lr"), F.col("phi"), F.col("df_phi"), "chi2"), 9))
    return regions.call_tiles(s, merge=False).select("chrom", *big("start"), *r6("pvalue", "qvalue"), "dmr_type")


@query("tile_regions")
def _(spark, d):
    return regions.tile_regions(store(spark, d), TREATED, CONTROLS)


def dvc(spark, d, least=0.6):
    """Sites with a flag; three samples against three have no statistic above 4."""
    b = site_tests.brown_forsythe(store(spark, d), TREATED, CONTROLS)
    return b.withColumn("is_dvc", F.coalesce(F.round("f_stat", 4) > least, F.lit(False)))


@query("variance_density", with_(STORE, BF) + """, s AS (SELECT chrom, pos, coalesce(round(CASE WHEN within>1e-15 THEN (na*(ma-g)*(ma-g)+nb*(mb-g)*(mb-g))/(within/(na+nb-2)) END,4)>0.6,false) AS dv, CASE WHEN va>0 AND vb>0 THEN sign(log2(va/vb)) END AS sg FROM w)
 SELECT chrom, pos//1000*1000 AS start, count(*) AS n_cpgs, sum(dv::INT)::BIGINT AS n_dvc, CASE WHEN sum(sg) FILTER (dv)>0 THEN 'more_variable' WHEN sum(sg) FILTER (dv)<0 THEN 'less_variable' ELSE 'mixed' END AS direction FROM s GROUP BY ALL HAVING count(*)>=5""")
def _(spark, d):
    return regions.variance_density(dvc(spark, d)).select("chrom", *big("start", "n_cpgs", "n_dvc"), "direction")


@query("variance_regions", with_(STORE, BF) + f""", s AS (SELECT chrom, pos, coalesce(round(CASE WHEN within>1e-15 THEN (na*(ma-g)*(ma-g)+nb*(mb-g)*(mb-g))/(within/(na+nb-2)) END,4)>0.6,false) AS dv FROM w),
 t AS (SELECT chrom, pos//1000*1000 AS start, count(*)::DOUBLE AS n, sum(dv::INT)::DOUBLE AS k FROM s GROUP BY ALL HAVING count(*)>=5), r AS (SELECT avg(dv::INT) AS rate FROM s),
 sites AS (SELECT chrom, start, n, k, CASE WHEN k<=0 THEN 1.0 ELSE {beta_sql('k', '(n-k+1)', 'rate')} END AS p FROM t, r), {BH}
 SELECT chrom, start, n::BIGINT AS n_cpgs, k::BIGINT AS n_dvc, round(p,6)+0.0 AS pvalue, round(q,6)+0.0 AS qvalue FROM bh WHERE k>0""")
def _(spark, d):
    """Every tile with a variable site, so that no threshold hides one."""
    return regions.variance_regions(dvc(spark, d), alpha=1.1).select("chrom", *big("start", "n_cpgs", "n_dvc"), *r6("pvalue", "qvalue"))


@query("merge_intervals", with_(BED) + """, l AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM bed), i AS (SELECT *, sum(CASE WHEN r IS NULL OR s>r THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS id FROM l)
 SELECT chrom, min(s) AS start, max(e) AS "end", count(*) AS n_merged FROM i GROUP BY chrom, id""")
def _(spark, d):
    return intervals.merge_intervals(beds(spark, d)).select("chrom", *big("start", "end", "n_merged"))


@query("diagnose_regions", with_(STORE, GROUPS, LR, SITES, BH, CHAIN, BED) + """, q AS (SELECT bed.chrom, s, e, count(*) AS n, min(round(q,9)) AS mq FROM bed JOIN (SELECT chrom AS c, pos, q FROM bh) ON c=bed.chrom AND pos>=s AND pos<=e GROUP BY bed.chrom, s, e),
 r AS (SELECT DISTINCT chrom, s, e FROM bed)
 SELECT r.chrom, r.s AS start, r.e AS "end", coalesce(n,0) AS n_sites, CASE WHEN EXISTS (SELECT 1 FROM chains c WHERE c.chrom=r.chrom AND r.s<=c.e AND c.s<=r.e) THEN 'overlap' WHEN n IS NULL THEN 'no_sites' WHEN mq>=0.05 THEN 'no_signal' WHEN mq>=1e-5 THEN 'weak_signal' ELSE 'structural' END AS bucket
 FROM r LEFT JOIN q ON q.chrom=r.chrom AND q.s=r.s AND q.e=r.e""")
def _(spark, d):
    s = fdr.adjust(sites(spark, d)).filter("qvalue is not null").withColumn("qvalue", F.round("qvalue", 9))
    return regions.diagnose(beds(spark, d), chains(spark, d), s).select("chrom", *big("start", "end", "n_sites"), "bucket")


# ---- segmentation --------------------------------------------------------------


@query("hmm_states")
def _(spark, d):
    return segment.states(store(spark, d), [0.2, 0.6], 0.9)


@query("pmd")
def _(spark, d):
    return segment.pmd(store(spark, d), bandwidth_bp=2000, min_bp=2000, self_loop=0.9)


@query("hmr")
def _(spark, d):
    return segment.hmr(store(spark, d))


@query("segment_regions")
def _(spark, d):
    return segment.segment_regions(sites(spark, d))


@query("state_runs", with_(STORE) + ", s AS (SELECT sample, chrom, pos, CASE WHEN n_meth/coverage<0.3 THEN 0 ELSE 1 END AS st FROM store), r AS (SELECT *, row_number() OVER w - sum(CASE WHEN st=0 THEN 1 ELSE 0 END) OVER w AS id FROM s WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)) SELECT sample, chrom, min(pos) AS start, max(pos)+1 AS \"end\", count(*) AS n FROM r WHERE st=0 GROUP BY sample, chrom, id")
def _(spark, d):
    s = store(spark, d).withColumn("state", F.when(F.col("N_meth") / F.col("coverage") < 0.3, 0).otherwise(1))
    return segment.runs_of_state(s, 0).select("sample", "chrom", *big("start", "end", "n"))


# ---- annotation -----------------------------------------------------------------

FEATURES = """tss AS (SELECT *, CASE WHEN strand='-' THEN e-1 ELSE s END AS tss, CASE WHEN strand='-' THEN s ELSE e-1 END AS tes FROM genes),
ex AS (SELECT chrom, s+k*2*((e-s)//5) AS s, s+(k*2+1)*((e-s)//5) AS e, gene FROM genes, (SELECT unnest([0,1,2]) AS k)),
rx AS (SELECT *, max(e) OVER (PARTITION BY gene ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ex),
feat AS (
 SELECT chrom, greatest(0, CASE WHEN strand<>'-' THEN tss-2000 ELSE tss-200+1 END) AS fs, CASE WHEN strand<>'-' THEN tss+200 ELSE tss+2000+1 END AS fe, gene, 'promoter' AS f, 0 AS r FROM tss
 UNION ALL SELECT chrom, greatest(0, CASE WHEN strand<>'-' THEN tes-100 ELSE tes-1000+1 END), CASE WHEN strand<>'-' THEN tes+1000 ELSE tes+100+1 END, gene, 'TTS', 3 FROM tss
 UNION ALL SELECT chrom, s, e, gene, 'exon', 4 FROM ex
 UNION ALL SELECT rx.chrom, coalesce(greatest(rx.r, g.s), g.s), least(rx.s, g.e), rx.gene, 'intron', 5 FROM rx JOIN genes g ON g.gene=rx.gene WHERE coalesce(greatest(rx.r, g.s), g.s)<least(rx.s, g.e)
 UNION ALL SELECT chrom, s, e, gene, 'noncoding', 6 FROM genes WHERE kind<>'protein_coding')"""


@query("annotate_features", with_(STORE, GENES, FEATURES) + """, u AS (SELECT DISTINCT chrom, pos FROM store),
 h AS (SELECT u.chrom, pos, min(struct_pack(r:=r, gene:=gene, f:=f)) AS b, list_sort(list(DISTINCT f)) AS fs FROM u JOIN feat ON u.chrom=feat.chrom AND pos>=fs AND pos<fe GROUP BY u.chrom, pos)
 SELECT u.chrom, u.pos AS start, coalesce(b.f,'intergenic') AS feature_type, b.gene AS gene_id, array_to_string(fs,',') AS features, coalesce(CASE WHEN t.strand='-' THEN t.tss-u.pos ELSE u.pos-t.tss END,-2147483648) AS tss_distance,
  (SELECT min(abs(u.pos-x.tss)) FROM tss x WHERE x.chrom=u.chrom) AS nearest_distance
 FROM u LEFT JOIN h ON h.chrom=u.chrom AND h.pos=u.pos LEFT JOIN tss t ON t.gene=b.gene""")
def _(spark, d):
    g = genes(spark, d)
    f = annotate.feature_table(g, exons(spark, d))
    a = annotate.annotate_features(align.union_sites(store(spark, d), ALL).withColumn("pos", F.col("pos").cast("long")), f, g)
    return a.select("chrom", *big("start"), "feature_type", "gene_id", F.when(F.col("all_features").isNotNull(), F.concat_ws(",", "all_features")).alias("features"), F.coalesce("tss_distance", F.lit(-2147483648)).cast("long").alias("tss_distance"), *big("nearest_distance"))


@query("annotate_islands", with_(STORE, BED) + """, u AS (SELECT DISTINCT chrom, pos FROM store), i AS (SELECT chrom, s*20 AS s, s*20+300 AS e FROM bed),
 h AS (SELECT u.chrom, pos, min(CASE WHEN pos>=s AND pos<e THEN 0 WHEN greatest(s-pos, pos+1-e)<=2000 THEN 1 ELSE 2 END) AS r FROM u JOIN i ON i.chrom=u.chrom AND pos>=s-4000 AND pos<e+4000 GROUP BY u.chrom, pos)
 SELECT u.chrom, u.pos AS start, CASE r WHEN 0 THEN 'island' WHEN 1 THEN 'shore' WHEN 2 THEN 'shelf' ELSE 'open_sea' END AS cpg_context FROM u LEFT JOIN h ON h.chrom=u.chrom AND h.pos=u.pos""")
def _(spark, d):
    i = beds(spark, d).select("chrom", (F.col("start") * 20).alias("start"), (F.col("start") * 20 + 300).alias("end"))
    return annotate.annotate_islands(align.union_sites(store(spark, d), ALL).withColumn("pos", F.col("pos").cast("long")), i).select("chrom", *big("start"), "cpg_context")


def _annotated(spark, d):
    i = beds(spark, d).select("chrom", (F.col("start") * 20).alias("start"), (F.col("start") * 20 + 300).alias("end"))
    return annotate.annotate_islands(align.union_sites(store(spark, d), ALL).withColumn("pos", F.col("pos").cast("long")), i).withColumn("feature_type", F.col("cpg_context"))


ISLANDS = with_(STORE, BED) + """, u AS (SELECT DISTINCT chrom, pos FROM store), i AS (SELECT chrom, s*20 AS s, s*20+300 AS e FROM bed),
 h AS (SELECT u.chrom, pos, min(CASE WHEN pos>=s AND pos<e THEN 0 WHEN greatest(s-pos, pos+1-e)<=2000 THEN 1 ELSE 2 END) AS r FROM u JOIN i ON i.chrom=u.chrom AND pos>=s-4000 AND pos<e+4000 GROUP BY u.chrom, pos),
 a AS (SELECT u.chrom, u.pos, CASE r WHEN 0 THEN 'island' WHEN 1 THEN 'shore' WHEN 2 THEN 'shelf' ELSE 'open_sea' END AS f FROM u LEFT JOIN h ON h.chrom=u.chrom AND h.pos=u.pos)
"""


@query("annotation_counts", ISLANDS + "SELECT f AS feature, count(*) AS n FROM a GROUP BY f")
def _(spark, d):
    return aggregate.annotation_counts(_annotated(spark, d))


@query("categorical_shares", ISLANDS + "SELECT grp, f AS feature, n, round(n/sum(n) OVER (PARTITION BY grp),6)+0.0 AS share FROM (SELECT chrom AS grp, f, count(*) AS n FROM a GROUP BY chrom, f UNION ALL SELECT 'all', f, count(*) FROM a GROUP BY f)")
def _(spark, d):
    return aggregate.categorical_shares(_annotated(spark, d), "chrom").select("grp", "feature", "n", *r6("share"))


@query("numeric_by_annotation", ISLANDS + "SELECT feature, count(*) AS n, round(avg(v),6)+0.0 AS mean_value FROM (SELECT f AS feature, pos AS v FROM a UNION ALL SELECT 'All', pos FROM a) GROUP BY feature")
def _(spark, d):
    return aggregate.numeric_by_annotation(_annotated(spark, d), "start").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select("feature", "n", *r6("mean_value"))


@query("coannotation", with_(STORE, GENES, FEATURES) + """, u AS (SELECT DISTINCT chrom, pos FROM store), h AS (SELECT DISTINCT u.chrom, pos, f FROM u JOIN feat ON u.chrom=feat.chrom AND pos>=fs AND pos<fe)
 SELECT x.f AS a, y.f AS b, count(*) AS n FROM h x JOIN h y ON x.chrom=y.chrom AND x.pos=y.pos GROUP BY x.f, y.f""")
def _(spark, d):
    g = genes(spark, d)
    a = annotate.annotate_features(align.union_sites(store(spark, d), ALL).withColumn("pos", F.col("pos").cast("long")), annotate.feature_table(g, exons(spark, d)), g)
    return aggregate.coannotation(a, "all_features", ("chrom", "start", "end"))


# ---- quality control ---------------------------------------------------------------


@query("conversion_rate", with_(STORE) + f"SELECT sample, {rd(('1-sum(n_meth)/sum(coverage)', 'conversion_rate'))} FROM store GROUP BY sample")
def _(spark, d):
    return qc.conversion_rate(store(spark, d).withColumn("context", F.lit("CHH"))).select("sample", *r6("conversion_rate"))


@query("global_methylation", with_(STORE) + """, g AS (SELECT sample, sum(n_meth)/sum(coverage) AS beta FROM store GROUP BY sample), m AS (SELECT median(beta) AS med FROM g), a AS (SELECT median(abs(beta-med)) AS mad FROM g, m)
 SELECT sample, """ + rd(("beta", "beta"), ("abs(beta-med)/(1.4826*mad)", "robust_z")) + ", coalesce(abs(beta-med)/(1.4826*mad)>3,false) AS is_outlier FROM g, m, a")
def _(spark, d):
    return qc.global_methylation(store(spark, d)).select("sample", *r6("beta", "robust_z"), "is_outlier")


@query("coverage_uniformity", with_(STORE) + """, g AS (SELECT sample, coalesce(chrom,'genome') AS chrom, count(*) AS n_sites, avg(coverage) AS m, avg((coverage>=100)::INT) AS f FROM store GROUP BY GROUPING SETS ((sample, chrom),(sample)))
 SELECT sample, chrom, n_sites, """ + rd(("m", "mean_coverage"), ("f", "frac_100x")) + ", m<0.5*max(CASE WHEN chrom='genome' THEN m END) OVER (PARTITION BY sample) AS low_coverage FROM g")
def _(spark, d):
    return qc.coverage_uniformity(store(spark, d), (100,)).select("sample", "chrom", *big("n_sites"), *r6("mean_coverage", "frac_100x"), "low_coverage")


@query("sex_check", with_(STORE) + """, g AS (SELECT sample, sum(n_meth)/sum(coverage) AS b FROM store WHERE chrom='chr1' AND coverage>=5 GROUP BY sample), l AS (SELECT *, lag(b) OVER (ORDER BY b, sample) AS p FROM g), t AS (SELECT arg_max((b+p)/2, b-p) AS t FROM l WHERE p IS NOT NULL)
 SELECT sample, round(b,6)+0.0 AS x_beta, CASE WHEN b<t THEN 'male' ELSE 'female' END AS inferred_sex FROM g, t""")
def _(spark, d):
    return qc.sex_check(store(spark, d), x_names=("1",)).select("sample", *r6("x_beta"), "inferred_sex")


@query("contamination", with_(STORE) + "SELECT sample, count(*) AS n_sites, round(avg((n_meth/coverage>0.2 AND n_meth/coverage<0.8)::INT),6)+0.0 AS intermediate_share FROM store WHERE coverage>=10 GROUP BY sample")
def _(spark, d):
    return qc.contamination(store(spark, d)).select("sample", *big("n_sites"), *r6("intermediate_share"))


SHARED = """sh AS (SELECT sample, chrom, pos, n_meth/coverage AS b FROM store WHERE coverage>=10 AND (chrom,pos) IN (SELECT (chrom,pos) FROM store WHERE coverage>=10 GROUP BY chrom, pos HAVING count(*)=6))"""


@query("sample_correlation", with_(STORE, SHARED) + f"SELECT x.sample AS sample_a, y.sample AS sample_b, {rd(('corr(x.b,y.b)', 'corr'))} FROM sh x JOIN sh y ON x.chrom=y.chrom AND x.pos=y.pos AND x.sample<=y.sample GROUP BY ALL")
def _(spark, d):
    return qc.sample_correlation(store(spark, d), ALL, "pearson").select("sample_a", "sample_b", *r6("corr"))


@query("sample_correlation_rank", with_(STORE, SHARED) + f", r AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY b)+(count(*) OVER (PARTITION BY sample, b)-1)/2.0 AS k FROM sh) SELECT x.sample AS sample_a, y.sample AS sample_b, {rd(('corr(x.k,y.k)', 'corr'))} FROM r x JOIN r y ON x.chrom=y.chrom AND x.pos=y.pos AND x.sample<=y.sample GROUP BY ALL")
def _(spark, d):
    return qc.sample_correlation(store(spark, d), ALL).select("sample_a", "sample_b", *r6("corr"))


def _coords(spark, d):
    p = parts(spark, d, 9)
    return p.select(F.col("p_partkey").cast("string").alias("cpg_id"), F.expr("concat('chr', p_partkey % 5 + 1)").alias("chrom"), F.expr("int((p_partkey div 5) * 100 + (p_partkey % 7) * 13)").alias("pos"), ((F.col("p_size") - 25) / 1000).alias("coefficient"))


@query("age_clock", with_(STORE) + """, c AS (SELECT p_partkey AS id, 'chr'||(p_partkey%5+1) AS chrom, (p_partkey//5)*100+(p_partkey%7)*13 AS pos, (p_size-25)/1000 AS w FROM part WHERE p_partkey%9=0), n AS (SELECT DISTINCT sample FROM store),
 b AS (SELECT id, w, n.sample, n_meth/coverage AS b FROM c CROSS JOIN n LEFT JOIN store s ON s.sample=n.sample AND s.chrom=c.chrom AND s.pos=c.pos), u AS (SELECT *, coalesce(b, avg(b) OVER (PARTITION BY id)) AS v FROM b),
 l AS (SELECT sample, count(v) AS n_sites, count(*) FILTER (b IS NULL AND v IS NOT NULL) AS n_imputed, sum(v*w)+0.5 AS x FROM u GROUP BY sample)
 SELECT sample, n_sites, n_imputed, round(CASE WHEN x<0 THEN 21*exp(x)-1 ELSE 21*x+20 END,6)+0.0 AS age FROM l""")
def _(spark, d):
    c = _coords(spark, d)
    b = align.beta_at_clock_sites(store(spark, d), c, ALL)
    return qc.age_clock(b, c, 0.5, "horvath").select("sample", *big("n_sites", "n_imputed"), *r6("age"))


@query("deconvolve")
@whole
def _(spark, d):
    c = _coords(spark, d)
    ref = c.select("cpg_id", (F.pmod(F.xxhash64("cpg_id"), F.lit(100)) / 100).alias("cell_a"), (F.pmod(F.xxhash64("cpg_id", F.lit(1)), F.lit(100)) / 100).alias("cell_b"))
    return qc.deconvolve(align.beta_at_clock_sites(store(spark, d), c, ALL), ref, ["cell_a", "cell_b"])


# ---- reads ---------------------------------------------------------------------------


def _calls(spark, d):
    """Read calls made of line items: an order is a read, a part a site of its small neighbourhood."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.lit("s0").alias("sample"), F.concat(F.lit("chr"), F.expr("l_orderkey % 5 + 1")).alias("chrom"), F.col("l_orderkey").cast("string").alias("read_id"), F.expr("int((l_orderkey % 50) * 4 + (l_partkey % 5))").alias("pos"), F.expr("if(l_returnflag = 'R', 1, 0)").alias("methylation_status"))


@query("entropy", """WITH c AS (SELECT 'chr'||(l_orderkey%5+1) AS chrom, l_orderkey AS rid, (l_orderkey%50)*4+(l_partkey%5) AS pos, max(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS s FROM lineitem GROUP BY ALL),
 u AS (SELECT *, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS p1 FROM (SELECT DISTINCT chrom, pos FROM c)), v AS (SELECT *, lead(pos) OVER w AS q1, lead(s) OVER w AS s1 FROM c WINDOW w AS (PARTITION BY chrom, rid ORDER BY pos)),
 g AS (SELECT v.chrom, v.pos, p1, s+2*s1 AS pt, count(*) AS k FROM v JOIN u ON u.chrom=v.chrom AND u.pos=v.pos AND q1=p1 GROUP BY ALL)
 SELECT chrom, pos AS start, p1+1 AS "end", sum(k)::BIGINT AS n_reads, count(*) AS n_patterns, round(log2(sum(k))-sum(k*log2(k))/sum(k),6)+0.0 AS entropy FROM g GROUP BY chrom, pos, p1 HAVING sum(k)>=5""")
def _(spark, d):
    return reads.entropy(_calls(spark, d), 2, 5).select("chrom", *big("start", "end", "n_reads", "n_patterns"), *r6("entropy"))


@query("allele_counts", """WITH c AS (SELECT 'chr'||(l_orderkey%5+1) AS chrom, l_orderkey AS rid, (l_orderkey%50)*4+(l_partkey%5) AS pos, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS m, l_orderkey%2 AS h FROM lineitem),
 g AS (SELECT chrom, pos, sum(CASE WHEN h=0 AND m=1 THEN 1 ELSE 0 END)::BIGINT AS m0, sum(CASE WHEN h=0 AND m=0 THEN 1 ELSE 0 END)::BIGINT AS u0, sum(CASE WHEN h=1 AND m=1 THEN 1 ELSE 0 END)::BIGINT AS m1, sum(CASE WHEN h=1 AND m=0 THEN 1 ELSE 0 END)::BIGINT AS u1 FROM c GROUP BY chrom, pos)
 SELECT * FROM g WHERE m0+u0>=2 AND m1+u1>=0""")
def _(spark, d):
    c = _calls(spark, d)
    phased = c.select("sample", "read_id", F.expr("cast(read_id as bigint) % 2").cast("int").alias("haplotype")).distinct()
    return reads.allele_counts(c, phased, 0).filter("m0 + u0 >= 2").select("chrom", *big("pos", "m0", "u0", "m1", "u1"))


@query("allele_specific", """WITH c AS (SELECT 'chr'||(l_orderkey%5+1) AS chrom, (l_orderkey%50)*4+(l_partkey%5) AS pos, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS m, (l_orderkey//50)%2 AS h FROM lineitem),
 g AS (SELECT chrom, pos, sum(CASE WHEN h=0 AND m=1 THEN 1 ELSE 0 END)::BIGINT AS m0, sum(CASE WHEN h=0 AND m=0 THEN 1 ELSE 0 END)::BIGINT AS u0, sum(CASE WHEN h=1 AND m=1 THEN 1 ELSE 0 END)::BIGINT AS m1, sum(CASE WHEN h=1 AND m=0 THEN 1 ELSE 0 END)::BIGINT AS u1 FROM c GROUP BY chrom, pos),
 f AS (SELECT *, m0 AS a, m0+u0 AS ra, m0+m1 AS m, m1+u1 AS rb, m0+u0+m1+u1 AS n FROM g WHERE m0+u0>=1 AND m1+u1>=1), k AS (SELECT *, unnest(range(greatest(0, m-rb), least(ra, m)+1)) AS x FROM f),
 lp AS (SELECT *, lgamma(ra+1)-lgamma(x+1)-lgamma(ra-x+1)+lgamma(rb+1)-lgamma(m-x+1)-lgamma(rb-m+x+1)-lgamma(n+1)+lgamma(m+1)+lgamma(n-m+1) AS l FROM k),
 o AS (SELECT *, exp(l) AS pmf, max(CASE WHEN x=a THEN exp(l) END) OVER (PARTITION BY chrom, pos) AS po FROM lp)
 SELECT chrom, pos, any_value(m0) AS m0, any_value(u0) AS u0, any_value(m1) AS m1, any_value(u1) AS u1, round(CASE WHEN any_value(m) IN (0, any_value(n)) THEN 1.0 ELSE least(1.0, sum(CASE WHEN pmf<=po*(1+1e-7)+1e-15 THEN pmf ELSE 0 END)) END, 6)+0.0 AS pvalue FROM o GROUP BY chrom, pos""")
def _(spark, d):
    """The haplotype of a read is that of its order's block of fifty."""
    c = _calls(spark, d)
    snvs = spark.createDataFrame([(f"chr{i}", 1000, "A", "G") for i in range(1, 6)], "chrom string, pos int, ref string, alt string")
    bases = c.select("sample", "read_id", "chrom").distinct().select("sample", "read_id", "chrom", F.lit(1000).alias("pos"), F.expr("if((cast(read_id as bigint) div 50) % 2 = 0, 'A', 'G')").alias("base"), F.lit("+").alias("strand"))
    return reads.allele_specific(c, bases, snvs, 1).select("chrom", *big("pos", "m0", "u0", "m1", "u1"), *r6("pvalue"))


# ---- plot data and exports --------------------------------------------------------------


@query("site_matrix", with_(STORE) + "SELECT chrom, pos, " + ", ".join(f"round(max(CASE WHEN sample='{s}' THEN n_meth/coverage END),6)+0.0 AS {s}" for s in ALL) + " FROM store WHERE pos%7=0 GROUP BY chrom, pos HAVING count(*)=6")
def _(spark, d):
    return plotdata.site_matrix(store(spark, d), ALL, 7).select("chrom", *big("pos"), *r6(*ALL))


@query("pca")
def _(spark, d):
    xy, share = plotdata.pca(plotdata.site_matrix(store(spark, d), ALL), ALL)
    return spark.createDataFrame([(s, float(abs(a)), float(abs(b)), float(share[0])) for s, (a, b) in zip(ALL, xy)], "sample string, pc1 double, pc2 double, share1 double")


@query("tss_metaplot", with_(STORE, GENES) + """, t AS (SELECT chrom, strand, CASE WHEN strand='-' THEN e-1 ELSE s END AS t FROM genes), r AS (SELECT sample, n_meth/coverage AS b, CASE WHEN t.strand='-' THEN t-pos ELSE pos-t END AS o FROM store s JOIN t ON s.chrom=t.chrom AND pos>=greatest(0,t-2000) AND pos<t+2000 WHERE t+2000>0)
 SELECT sample, least(19, floor((o+2000)*20/4000))::BIGINT AS bin, round(avg(b),6)+0.0 AS mean_beta, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, d):
    return plotdata.tss_metaplot(store(spark, d), genes(spark, d), n_bins=20).select("sample", *big("bin"), *r6("mean_beta"), "n")


@query("gene_body_metaplot", with_(STORE, GENES) + """, r AS (SELECT sample, n_meth/coverage AS b, CASE WHEN g.strand='-' THEN e-1-pos ELSE pos-s END AS o, e-s AS z FROM store JOIN genes g ON store.chrom=g.chrom AND pos>=greatest(0,s-2000) AND pos<e+2000 WHERE e-s>=500)
 SELECT sample, CASE WHEN o<0 THEN floor((o+2000)*30/2000) WHEN o<z THEN 30+floor(o*40/z) ELSE 70+least(29,floor((o-z)*30/2000)) END::BIGINT AS bin, round(avg(b),6)+0.0 AS mean_beta, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, d):
    return plotdata.gene_body_metaplot(store(spark, d), genes(spark, d)).select("sample", *big("bin"), *r6("mean_beta"), "n")


@query("coverage_distribution", with_(STORE) + "SELECT sample, coverage//10*10 AS coverage_bin, count(*) AS n FROM store GROUP BY ALL")
def _(spark, d):
    return plotdata.coverage_distribution(store(spark, d)).select("sample", *big("coverage_bin"), "n")


@query("volcano", with_(STORE, GROUPS, LR, SITES, BH) + "SELECT chrom, pos, round(-log10(greatest(p,1e-300)),6)+0.0 AS neg_log10_p, round(q,9)<0.05 AND abs(d)>=0.1 AS significant, round(q,9)<0.05 AND abs(d)>=0.1 AND d>0 AS hyper FROM bh")
def _(spark, d):
    s = fdr.adjust(sites(spark, d)).filter("pvalue is not null").withColumn("qvalue", F.round("qvalue", 9))
    return plotdata.volcano(s).select("chrom", *big("pos"), *r6("neg_log10_p"), "significant", "hyper")


@query("ma_plot", with_(STORE, GROUPS, LR, SITES) + f"SELECT chrom, pos, {rd(('(ba+bb)/2+1e-9', 'mean_beta'), ('d', 'meth_diff'))} FROM sites")
def _(spark, d):
    s = plotdata.ma_plot(sites(spark, d).withColumn("qvalue", F.col("pvalue"))).withColumn("mean_beta", F.col("mean_beta") + 1e-9)
    return s.select("chrom", *big("pos"), *r6("mean_beta", "meth_diff"))


@query("manhattan", with_(STORE, GROUPS, LR, SITES) + ", o AS (SELECT chrom AS c, sum(max(pos)+10000000) OVER (ORDER BY chrom)-max(pos)-10000000 AS o FROM sites GROUP BY chrom) SELECT chrom, pos, (pos+o)::BIGINT AS x FROM sites JOIN o ON c=chrom")
def _(spark, d):
    return plotdata.manhattan(sites(spark, d)).select("chrom", *big("pos", "x"))


@query("pvalue_histogram", with_(STORE, GROUPS, LR, SITES) + "SELECT least(29,floor(p*30))::BIGINT AS bin, count(*) AS n FROM sites WHERE p IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return plotdata.pvalue_histogram(sites(spark, d)).select(*big("bin"), "n")


@query("karyogram", with_(STORE, GROUPS, LR, SITES) + "SELECT chrom, pos//5000 AS bin, round(avg(d),6)+0.0 AS mean_value, count(*) AS n FROM sites GROUP BY ALL")
def _(spark, d):
    return plotdata.karyogram(sites(spark, d), bin_bp=5000).select("chrom", *big("bin"), *r6("mean_value"), "n")


@query("region_sizes", with_(BED) + "SELECT chrom, s AS start, e AS \"end\", e-s AS width FROM bed")
def _(spark, d):
    return plotdata.region_sizes(beds(spark, d).withColumn("n_cpgs", F.lit(0))).select("chrom", *big("start", "end", "width"))


@query("set_overlaps", with_(BED) + ", m AS (SELECT id, (id::BIGINT%2=0)::INT+2*(id::BIGINT%3=0)::INT+4*(id::BIGINT%5=0)::INT AS mask FROM bed) SELECT mask::BIGINT AS mask, count(*) AS n FROM m WHERE mask>0 GROUP BY mask")
def _(spark, d):
    b = beds(spark, d)
    return plotdata.set_overlaps({"a": b.filter("region_id % 2 = 0"), "b": b.filter("region_id % 3 = 0"), "c": b.filter("region_id % 5 = 0")}, ("chrom", "start", "end", "region_id")).select(*big("mask"), "n")


@query("top_sites", with_(STORE, GROUPS, LR, SITES) + ", t AS (SELECT chrom, pos, d FROM sites ORDER BY abs(d) DESC, chrom, pos LIMIT 50) SELECT t.chrom, t.pos, round(any_value(d),6)+0.0 AS meth_diff, round(max(CASE WHEN sample='s0' THEN n_meth/coverage END),6)+0.0 AS s0, round(max(CASE WHEN sample='s5' THEN n_meth/coverage END),6)+0.0 AS s5 FROM t JOIN store ON store.chrom=t.chrom AND store.pos=t.pos GROUP BY t.chrom, t.pos")
def _(spark, d):
    return plotdata.top_sites(sites(spark, d), store(spark, d), ALL, 50).select("chrom", *big("pos"), *r6("meth_diff", "s0", "s5"))


@query("region_matrix", with_(STORE, BED) + f"SELECT sample, bed.chrom, s AS start, e AS \"end\", {rd(('sum(n_meth)/sum(coverage)', 'beta'))}, count(*) AS n_sites FROM store JOIN (SELECT DISTINCT chrom, s, e FROM bed) bed ON store.chrom=bed.chrom AND pos>=s AND pos<=e GROUP BY ALL")
def _(spark, d):
    return plotdata.region_matrix(store(spark, d), beds(spark, d), ALL).select("sample", "chrom", *big("start", "end"), *r6("beta"), "n_sites")


@query("region_stats", with_(STORE, GROUPS, LR, SITES, CHAIN) + "SELECT count(*) AS n_regions, count(*) FILTER (kind='hyper') AS n_hyper, count(*) FILTER (kind='hypo') AS n_hypo, round(median(e-s),6)+0.0 AS median_width FROM chains")
def _(spark, d):
    return plotdata.region_stats(chains(spark, d)).select("n_regions", *big("n_hyper", "n_hypo"), *r6("median_width"))


@query("site_stats", with_(STORE, GROUPS, LR, SITES, BH) + ", s AS (SELECT *, round(q,9)<0.05 AND abs(d)>=0.1 AS sig FROM bh) SELECT count(*) AS n_sites, count(*) FILTER (sig) AS n_sig, count(*) FILTER (sig AND d>0) AS n_hyper, count(*) FILTER (sig AND d<0) AS n_hypo, round(median(abs(d)) FILTER (sig),6)+0.0 AS median_abs_diff FROM s")
def _(spark, d):
    s = fdr.adjust(sites(spark, d)).filter("qvalue is not null").withColumn("qvalue", F.round("qvalue", 9))
    return plotdata.site_stats(s).select(*big("n_sites", "n_sig", "n_hyper", "n_hypo"), *r6("median_abs_diff"))


@query("qc_status", with_(STORE) + "SELECT sample, CASE WHEN avg(coverage)>=125 THEN 'ok' WHEN avg(coverage)>=120 THEN 'warn' ELSE 'fail' END AS status FROM store GROUP BY sample")
def _(spark, d):
    m = store(spark, d).groupBy("sample").agg(F.avg("coverage").alias("mean_coverage"))
    return plotdata.qc_status(m, {"mean_coverage": (125, 120)}).select("sample", "status")


@query("region_violin", with_(STORE, GROUPS, LR) + "SELECT CASE WHEN diff>=0 THEN 'hyper' ELSE 'hypo' END AS split, g AS grp, count(*) AS n, round(avg(b),6)+0.0 AS mean_beta FROM (SELECT diff, 'case' AS g, ba AS b FROM lrs UNION ALL SELECT diff, 'control', bb FROM lrs) GROUP BY ALL")
def _(spark, d):
    s = site_tests.lr_statistic(aggregate.site_groups(store(spark, d), TREATED, CONTROLS, "intersect"), "site").select(F.when(F.col("meth_diff") >= 0, "hyper").otherwise("hypo").alias("dmr_type"), F.col("beta_case").alias("mean_beta_case"), F.col("beta_ctrl").alias("mean_beta_control"))
    return plotdata.region_violin(s).groupBy("split", F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("beta").alias("mean_beta")).select("split", "grp", "n", *r6("mean_beta"))


@query("bedgraph", with_(STORE) + f"SELECT chrom, pos AS start, pos+1 AS \"end\", {rd(('n_meth/coverage', 'value'))} FROM store WHERE sample='s0' AND coverage>0")
def _(spark, d):
    return writers.bedgraph(store(spark, d), "s0").select("chrom", *big("start", "end"), *r6("value"))


@query("sites_bed", with_(STORE, GROUPS, LR, SITES, BH) + ", s AS (SELECT *, round(q,9) AS qq FROM bh WHERE round(q,9)<0.05 AND abs(d)>=0.1) SELECT chrom, pos AS start, pos+1 AS \"end\", 'dmc_'||row_number() OVER (ORDER BY chrom, pos) AS name, trunc(1000*(1-qq))::BIGINT AS score, CASE WHEN d>=0 THEN '+' ELSE '-' END AS strand FROM s")
def _(spark, d):
    s = fdr.adjust(sites(spark, d)).filter("qvalue is not null").withColumn("qvalue", F.round("qvalue", 9))
    return writers.sites_bed(s, 0.05, 0.1).select("chrom", *big("start", "end"), "name", *big("score"), "strand")


@query("per_sample_rows", with_(STORE) + f"SELECT sample, chrom||'.'||(pos+1) AS chrBase, 'F' AS strand, coverage, {rd(('100*n_meth/coverage', 'freqC'), ('100*(coverage-n_meth)/coverage', 'freqT'))} FROM store WHERE coverage>0")
def _(spark, d):
    return writers.per_sample_rows(store(spark, d)).select("sample", "chrBase", "strand", *big("coverage"), *r6("freqC", "freqT"))


@query("site_layer", with_(STORE) + "SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos)-1 AS idx, " + ", ".join(f"max(CASE WHEN sample='{s}' THEN coverage END)::DOUBLE AS {s}" for s in ALL) + " FROM store GROUP BY chrom, pos")
def _(spark, d):
    return writers.matrix(store(spark, d), ALL, "coverage").select("chrom", *big("pos"), F.col("index").cast("long").alias("idx"), *ALL)


@query("power_table")
def _(spark, d):
    rows = [(float(x), n, float(qc.power(x, 30, n))) for x in np.arange(0.05, 0.35, 0.05) for n in (3, 5)]
    return spark.createDataFrame(rows, "diff double, n_per_group int, power double")


# ---- of all parts -------------------------------------------------------------------

for _name in ("query_regions", "filter_sites", "blacklist", "aggregate_regions", "merge_intervals", "diagnose_regions", "annotate_features", "annotate_islands", "annotation_counts", "categorical_shares", "numeric_by_annotation", "coannotation", "age_clock", "tss_metaplot", "gene_body_metaplot", "region_sizes", "set_overlaps", "region_matrix"):
    query(f"{_name}_full")(whole(QUERIES[_name]))

"""One job that builds every mart from a landing folder.

Layout of the landing folder (one sub-folder per feed, any number of files):

    benchmarks/*.csv  notable/*.csv  gpu_clusters/*.csv  ml_hardware/*.csv
    catalog/*.json    hub_top/*.json hub_trending/*.json hub_modality/*.json
    leaderboard/*.html  pypi/*.json

Only the newest landed snapshot of each feed is used, with all its files (per
package for package stats, per tag for the tag responses), as the dashboard
used its latest fetch. Its paths come from the feed's manifest (``_manifest/<feed>``,
kept by the landing stream) or from the folder's listing, so older files are not
opened. Missing feeds are skipped
(their marts are not written). Sub-plans used by
several marts (the catalog scan, the release timeline) are checkpointed to
the cluster's shared checkpoint folder, so each is computed once and a lost
executor does not send the later marts back to the raw files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from rankmart.plans import marts as M
from rankmart.session import apply_runtime_conf, checkpoint_dir
from rankmart.sources import feeds as S
from rankmart.sources.manifest import manifest_of, newest_of_feed, package_of_name
from rankmart.sources.publish import Refresh
from rankmart.sources.sinks import write_mart


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def build_all(spark: SparkSession, landing: str, out: str, as_of: str, snapshot_date: str | None = None) -> dict:
    """Build and write every mart whose feed is landed; returns {mart: path}."""
    apply_runtime_conf(spark)
    checkpoint_dir(spark)
    snap = snapshot_date or str(as_of)[:10]
    written: dict[str, str] = {}

    def feed(name, key=None):
        """Paths of the feed's newest landing, so that no older file is opened; None if nothing is landed."""
        p = os.path.join(landing, name)
        if not _exists(spark, p):
            return None
        known = manifest_of(landing, name)
        return newest_of_feed(spark, p, manifest=known if _exists(spark, known) else None, key=key) or None

    def every_landing(name):
        p = os.path.join(landing, name)
        return p if _exists(spark, p) else None

    def put(name: str, df: DataFrame):
        path = os.path.join(out, name)
        write_mart(df, path, snap)
        written[name] = path

    if (p := feed("benchmarks")):
        bench = S.read_csv(spark, p, S.BENCH_SCORES, with_file=True)
        put("leaderboard", M.leaderboard_matrix(bench))
        put("leaderboard_insight", M.leaderboard_insight(bench))
    else:
        bench = None

    if (p := feed("notable")):
        notable = S.read_csv(spark, p, S.NOTABLE_MODELS, with_order=True, with_file=True)
        tl = M.timeline(notable, bench).checkpoint()
        put("timeline", tl)
        put("timeline_sizes", M.timeline_sizes(tl))
        put("timeline_flagship", M.flagship(tl.filter("NOT has_compute"), as_of))
        put("timeline_insight", M.timeline_insight(tl, as_of))

    if (p := feed("catalog")):
        catalog = S.read_catalog(spark, p).checkpoint()
        priced = M.pricing(catalog, as_of)
        put("pricing", priced)
        put("pricing_insight", M.pricing_insight(priced))
        put("context_buckets", M.context_buckets(spark, catalog))
        put("context_insight", M.context_insight(catalog))
        put("capabilities", M.capabilities(catalog))

    if (p := feed("ml_hardware")):
        hw = S.read_csv(spark, p, S.ML_HARDWARE, with_file=True)
        put("chips", M.chip_dominance(hw))
        put("chips_insight", M.chip_insight(hw))

    if (p := feed("gpu_clusters")):
        cl = S.read_csv(spark, p, S.GPU_CLUSTERS, with_file=True)
        mapped = M.gpu_map(cl).checkpoint()
        put("gpu_map", mapped)
        put("gpu_regions", M.gpu_region_counts(mapped))
        put("gpu_stats", M.gpu_stats(cl))
        put("gpu_owners", M.gpu_top_owners(cl))
        put("gpu_countries", M.gpu_country_counts(cl))
        put("gpu_insight", M.gpu_insight(cl))

    if (p := feed("hub_top")):
        top = M.downloads(S.read_hub_models(spark, p), as_of)
        put("downloads", top)
        put("downloads_insight", M.downloads_insight(top))
    if (p := feed("hub_trending")):
        tr = M.trending(S.read_hub_models(spark, p), as_of)
        put("trending", tr)
        put("trending_insight", M.trending_insight(tr))
    if (p := every_landing("hub_modality")):  # the newest response per tag, and tags are known from the payload only
        champs = S.modality_champions_from_hub(spark, S.newest_snapshot(S.read_hub_models(spark, p), "pipeline_tag"))
        mc = M.modality_champions(champs)
        put("modality_champions", mc)
        put("modality_insight", M.modality_insight(mc))
    if (p := feed("leaderboard")):
        board = M.coding_leaderboard(S.read_leaderboard_page(spark, p))
        put("coding", board)
        put("coding_insight", M.coding_insight(board))
    if (p := feed("pypi", package_of_name())):
        put("packages", M.package_downloads(S.newest_snapshot(S.read_package_downloads(spark, p), "package")))
    return written


def build_published(spark: SparkSession, landing: str, root: str, as_of: str, snapshot_date: str | None = None) -> int:
    """Build every mart into a new version of ``root`` and publish all of them at once; returns the version.

    Readers (``rankmart.sources.publish.Published``) see the version before until the last mart is written, and
    still do if the build fails.
    """
    with Refresh(spark, root) as refresh:
        for name, path in build_all(spark, landing, refresh.folder, as_of, snapshot_date).items():
            refresh.add(name, path, spark.read.parquet(path).schema)
    return refresh.version


def main(argv=None) -> None:
    """spark-submit entry: build every mart from a landing folder.

    spark-submit --py-files rankmart.zip rankmart/plans/build.py --landing <landing folder> \
        --out <marts folder> --as-of "2025-06-01 00:00:00"
    """
    import argparse
    import json

    from rankmart.session import get_spark

    ap = argparse.ArgumentParser(description="Build every mart from landed feed files.")
    ap.add_argument("--landing", required=True, help="folder with one sub-folder per feed")
    ap.add_argument("--out", required=True, help="folder for the marts (one sub-folder each)")
    ap.add_argument("--as-of", required=True, help="reference time, e.g. '2025-06-01 00:00:00'")
    ap.add_argument("--publish", action="store_true", help="write a new version below --out and publish all marts at once")
    ap.add_argument("--snapshot-date", default=None, help="partition to write (default: the as-of date)")
    args = ap.parse_args(argv)
    spark = get_spark(app_name="rankmart-build")
    if args.publish:
        print(json.dumps({"version": build_published(spark, args.landing, args.out, args.as_of, args.snapshot_date)}))
        return
    written = build_all(spark, args.landing, args.out, args.as_of, args.snapshot_date)
    print(json.dumps(written, indent=1, sort_keys=True))


if __name__ == "__main__":
    main()

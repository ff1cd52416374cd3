"""Tables of the library's shapes derived from the test tables, as the same SQL for Spark and for an oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "rasters": "select cast(s_suppkey as bigint) image_id, s_name prefix, cast(4000+(s_suppkey*977)%3000 as int) width, cast(3000+(s_suppkey*613)%2500 as int) height, 3 bands, cast(400000+s_suppkey*5000 as double) gt0, cast(1+s_suppkey%4 as double)/2 gt1, cast(0 as double) gt2, cast(2500000-s_nationkey*1000 as double) gt3, cast(0 as double) gt4, -cast(1+s_suppkey%4 as double)/2 gt5, s_suppkey%7=3 is_invalid, s_suppkey%5=0 bgr from {supplier}",
    "gt_boxes": "select image_id, box_id, cast((o*131+p*17)%3900 as int) xmin, cast((o*71+p*29)%2900 as int) ymin, cast((o*131+p*17)%3900+20+(o%40)*4 as int) xmax, cast((o*71+p*29)%2900+20+(p%50)*4 as int) ymax, cast(1+n%4 as int) label from (select distinct cast(l_suppkey as bigint) image_id, (l_orderkey*10+l_linenumber)*2000000+l_partkey box_id, l_orderkey o, l_partkey p, l_linenumber n from {lineitem}) k",
    "detections": "select image_id, box_id det_id, cast(xmin+box_id%21-10 as int) xmin, cast(ymin+box_id%17-8 as int) ymin, cast(xmax+box_id%13-6 as int) xmax, cast(ymax+box_id%11-5 as int) ymax, cast(box_id%1009 as double)/cast(1009 as double) score, cast(case when box_id%13=0 then label%4 else label-1 end as int) label from {gt_boxes} where box_id%10<8 union all select image_id, -box_id, xmin+500, ymin+300, xmax+500, ymax+300, cast(box_id%997 as double)/cast(2000 as double), label-1 from {gt_boxes} where box_id%10=9",
    "cls_preds": "select doc_id, quality truth, cast(case when doc_id%5=0 then 1-quality else quality end as int) pred, cast(doc_id%101 as double)/cast(100 as double) prob1 from {labels}",
    "tile_results": "select event_id, ts, user_id job_id, cast(event_id%40 as int) block, cast(floor(value) as int) n_dets from {events}",
    "polys": "select image_id, box_id poly_id, label, concat('POLYGON ((', xmin,' ',ymin,',',xmax,' ',ymin,',',xmax,' ',ymax,',',cast(floor((xmin+xmax)/2) as int),' ',ymax+10,',',xmin,' ',ymax,',',xmin,' ',ymin,'))') wkt from {gt_boxes} where box_id%20=0",
    "mask_pixels": "select image_id, x, y, val, val%5 gt_label, case when (x+y)%7=0 then (val+1)%5 else val%5 end pred_label from {pixels}",
}
PIXELS = {
    "spark": "select cast(vec_id%20 as bigint) image_id, cast(i as int) x, cast(floor(vec_id/20) as int) y, cast(floor(least(greatest((cast(e as double)+1)*127.5,0),255)) as int) val from {embeddings} lateral view posexplode(embedding) t as i, e",
    "duckdb": "select cast(v.vec_id%20 as bigint) image_id, cast(t.i-1 as int) x, cast(floor(v.vec_id/20) as int) y, cast(floor(least(greatest((cast(v.embedding[t.i] as double)+1)*127.5,0),255)) as int) val from embeddings v, range(1,65) t(i)",
}


def _text(name: str, dialect: str) -> str:
    return PIXELS[dialect] if name == "pixels" else SQL[name]


def _needs(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


class Tables:
    """Base and derived tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._held = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._held:
            if name in BASE:
                self._held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = _text(name, "spark")
                self._held[name] = self.spark.sql(text, **{n: getattr(self, n) for n in _needs(text)})
        return self._held[name]

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """Spark SQL over these tables, each named in braces."""
        return self.spark.sql(text, **{n: more[n] if n in more else getattr(self, n) for n in _needs(text)})


def oracle(query: str) -> str:
    """The query with the derived tables it names (in braces) as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in order:
            return
        for n in _needs(_text(name, "duckdb")):
            visit(n)
        order.append(name)

    for n in _needs(query):
        visit(n)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    head = ", ".join(f"{n} as ({plain(_text(n, 'duckdb'))})" for n in order)
    body = plain(query).strip()
    if not head:
        return body
    if m := re.match(r"with (recursive )?", body, re.I):
        return f"with {m[1] or ''}{head}, {body[m.end():]}"
    return f"with {head} {body}"

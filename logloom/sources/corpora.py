"""The driver tables as logs: ``line_id, raw``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More lines than an array of a document can have, so that line ids never meet.
LINES = 1 << 31
#: Each corpus as its table, line id and raw line; ``{ts}`` stands for the formatted time stamp.
PLAIN = {
    "part": ("part", "p_partkey", "concat_ws(' ', p_name, p_type, p_brand)"),
    "orders": ("orders", "o_orderkey", "concat('order ', o_orderkey, ' status ', o_orderstatus, ' priority ', o_orderpriority, ' by customer ', o_custkey)"),
}
EVENT_LOGS = {
    "auth": ("MMM d HH:mm:ss", "%b %-d %H:%M:%S", "concat({ts},' host',user_id%5,' ',event_type,case when user_id%2=0 then concat('[',event_id,']') else '' end,': user ',user_id,' did ',event_type)"),
    "kippo": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "concat({ts},'+0000 [SSHService ',event_type,case when user_id%2=0 then concat(',',user_id,',10.0.0.',user_id%5) else '' end,'] ',event_type,' by user ',user_id)"),
    "syslog": ("MMM d HH:mm:ss", "%b %-d %H:%M:%S", "concat({ts},' host',user_id%5,' ',event_type,case when user_id%3=0 then '(pam_unix)' else '' end,case when user_id%2=0 then concat('[',event_id,']') else '' end,': user ',user_id)"),
    "bluegene": ("yyyy-MM-dd-HH.mm.ss", "%Y-%m-%d-%H.%M.%S", "concat('- ',event_id,' 2005.06.03 R02-M1-N',user_id,' ',{ts},'.000001 R02-M1-N',user_id,' RAS KERNEL ',upper(event_type),' user ',user_id)"),
    "raslog": ("yyyy-MM-dd-HH.mm.ss", "%Y-%m-%d-%H.%M.%S", "concat(event_id,' KERN_0802 KERNEL unit_ddr err_',event_type,' FATAL ',{ts},'.000001 - 0 -1 R00-M0 R00-M0-N',user_id,' SN',user_id,' EC',user_id,' user ',event_type)"),
    "vpnlog": ("E MMM d HH:mm:ss yyyy", "%a %b %-d %H:%M:%S %Y", "concat({ts},case when user_id%2=0 then concat(' 10.0.0.',user_id%5,':',user_id) else '' end,' ',event_type,' by ',user_id)"),
    "snort_secrepo": ("MM/dd-HH:mm:ss", "%m/%d-%H:%M:%S", "concat({ts},'.000001 [**] [1:',event_id,':3] ',event_type,' attempt')"),
    "snort_sotm34": ("MMM d HH:mm:ss", "%b %-d %H:%M:%S", "concat({ts},' bastion snort: [1:',event_id,':3] ',event_type,' attempt')"),
    "httpd": ("E MMM d HH:mm:ss yyyy", "%a %b %-d %H:%M:%S %Y", "concat('[',{ts},'] [',event_type,'] client ',user_id,' failed')"),
}
EVENT_LOGS["casper"] = EVENT_LOGS["syslog"]


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "doc":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs.select(F.posexplode(F.split("text", "\n")).alias("pos", "raw"), "doc_id").select((F.col("doc_id") * LINES + F.col("pos")).alias("line_id"), "raw")
    if name in PLAIN:
        table, line_id, raw = PLAIN[name]
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(line_id).cast("long").alias("line_id"), F.expr(raw).alias("raw"))
    stamp, _, raw = EVENT_LOGS[name]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("line_id"), F.expr(raw.format(ts=f"date_format(ts, '{stamp}')")).alias("raw"))


def corpus_sql(name: str) -> str:
    """The same corpus as a DuckDB subquery."""
    if name == "doc":
        return f"(select doc_id*{LINES}+u.i line_id, u.raw from (select doc_id, string_split(text, chr(10)) l from documents) d, lateral (select unnest(l) raw, unnest(range(len(l))) i) u)"
    if name in PLAIN:
        table, line_id, raw = PLAIN[name]
        return f"(select cast({line_id} as bigint) line_id, {raw} raw from {table})"
    _, stamp, raw = EVENT_LOGS[name]
    return f"(select cast(event_id as bigint) line_id, {raw.format(ts=f'strftime(ts, $${stamp}$$)')} raw from events)"

"""Queries over the text functions and metadata documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from occura.functions import text as X
from occura.plans.base import query, table
from occura.sources import documents


@query("term_name", "SELECT page_id, regexp_extract(url, '([^/#]*)$', 1) AS name FROM pages")
def term_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.term_name(F.col("url")).alias("name"))


@query("csv_quote", """SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.csv_quote(F.col("text")).alias("field"))


@query("xml_escape", """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS full_md5, length(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n FROM pages""")
def xml_escape(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.xml_escape(html)).alias("full_md5"), F.length(X.xml_escape(html, quotes=False)).cast("bigint").alias("n"))


@query("norm_path", "SELECT page_id, replace(replace(url, '/', chr(92)), chr(92), '/') AS path FROM pages")
def norm_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.norm_path(F.replace(F.col("url"), F.lit("/"), F.lit("\\"))).alias("path"))


@query("tag_text", r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: trim(x)), lambda x: x <> ''), '|') AS paras FROM pages""")
def tag_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.tag_text(F.col("html"), "p"), "|").alias("paras"))


@query("pub_date", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS pub_date FROM events")
def pub_date(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    doc = F.when(F.col("event_id") % 3 == 0, "<eml><pubDate> </pubDate></eml>").otherwise(F.concat(F.lit("<eml>\n<pubDate>\n "), day, F.lit("</pubDate><pubDate>x</pubDate></eml>")))
    return table(spark, sf_dir, "events").select("event_id", X.pub_date(F.regexp_replace(doc, "\n", " ")).alias("pub_date"))


@query("place_name", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_type || ', ' || user_id END AS place FROM events")
def place_name(spark, sf_dir):
    e, kind = F.col("event_id") % 3, F.col("event_type")
    doc = F.when(e == 0, F.concat(F.lit('{"name": " '), kind, F.lit(' "}'))).when(e == 1, F.concat(F.lit('{"name": "", "display_name": " '), kind, F.lit(",, "), F.col("user_id").cast("string"), F.lit(' , c"}'))).otherwise('{"x": 1}')
    return table(spark, sf_dir, "events").select("event_id", X.place_name(doc).alias("place"))


# Queries made of the pages' own and of values of each kind, in mixed order, with repeated, bare, unknown and empty keys.


def _made(spark, sf_dir):
    url = F.concat(F.lit("http://h/?sounds&q=a%20b&taxon_id="), F.col("page_id").cast("string"), F.lit(",7&x=1&place_id=3,y&"), X.query_part(F.col("url")), F.lit("&taxon_id=9&geo=any&captive=0&lat=1.50&d1=&list_id=z"))
    return table(spark, sf_dir, "pages").select("page_id", X.query_part(url).alias("query"))


@query("canonical_query", "SELECT page_id, 'taxon_id=' || page_id || ',7,9&place_id=3&q=a b&lat=1.5&captive=false&sounds=true' AS query FROM pages")
def canonical_query(spark, sf_dir):
    return _made(spark, sf_dir).select("page_id", X.canonical_query(F.col("query")).alias("query"))


@query("criteria_lines", "SELECT page_id, 'taxon_id: ' || page_id || ', 7, 9;place_id: 3;lat: 1.5;sounds: true;captive: false' AS criteria FROM pages")
def criteria_lines(spark, sf_dir):
    return _made(spark, sf_dir).select("page_id", F.array_join(X.criteria_lines(F.col("query")), ";").alias("criteria"))


_EML = """<?xml version="1.0"?><eml:eml xmlns:eml="eml://x"><dataset><title>{t}</title><creator><individualName><givenName>A</givenName><surName>{s}</surName></individualName></creator><creator><organizationName>Org</organizationName></creator><pubDate> 2024-02-03 </pubDate><language>{l}</language><abstract><para> {t} </para><para> </para></abstract></dataset></eml:eml>"""


@query("xml_extract", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 5 <> 0 THEN 'A ' || source || '|Org' END AS creators, CASE WHEN doc_id % 5 <> 0 THEN lang END AS language, CASE WHEN doc_id % 5 <> 0 THEN '2024-02-03' END AS pub_date FROM documents")
def xml_extract(spark, sf_dir):
    """Metadata documents made of the documents' columns; each fifth is cut off and so malformed."""
    doc = F.lit(_EML)
    for key, c in (("{t}", F.concat(F.lit("T"), F.col("doc_id").cast("string"))), ("{s}", F.col("source")), ("{l}", F.col("lang"))):
        doc = F.replace(doc, F.lit(key), c)
    doc = F.when(F.col("doc_id") % 5 == 0, F.substring(doc, 1, 60)).otherwise(doc)
    found = documents.eml_table(table(spark, sf_dir, "documents").select("doc_id", doc.alias("content")), "doc_id")
    return found.select("doc_id", "title", F.array_join("creators", "|").alias("creators"), "language", "pub_date")

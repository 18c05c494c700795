"""Access log, addresses, URLs and upload names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.functions import addresses as IP
from quireworks.functions import textcols as T

#: Status, code and seconds to wait of each cause.
ERRORS = (
    ("ip_limit", 429, "RATE_LIMITED", 30), ("queue_full", 503, "QUEUE_FULL", 15), ("storage_full", 507, "STORAGE_FULL", 60), ("not_found", 404, "JOB_NOT_FOUND", 0),
    ("expired", 410, "RESULT_EXPIRED", 0), ("not_ready", 409, "NOT_READY", 2), ("shutdown", 503, "SHUTTING_DOWN", 10), ("internal", 500, "INTERNAL_ERROR", 0),
)


def route_report(log: DataFrame) -> DataFrame:
    """Requests, bytes and milliseconds of each route and status; job ids in paths give way to a template."""
    route = F.when(F.col("path").rlike("^/api/conversions/[^/]+/download$"), "/api/conversions/{id}/download").when(F.col("path").rlike("^/api/conversions/[^/]+$"), "/api/conversions/{id}").otherwise(F.col("path"))
    return log.groupBy(route.alias("route"), "status").agg(F.count("*").alias("n"), F.sum("response_bytes").alias("n_bytes"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))


def host_of(remote: Column) -> Column:
    """The peer's address as it is usually spelled, an IPv4 in IPv6 clothes unwrapped; null where it can't be read."""
    return IP.spelled(IP.address(IP.peer_host(remote)))


def attribute_clients(log: DataFrame, trusted: tuple[str, ...]) -> DataFrame:
    """log(remote, forwarded) with client: behind a trusted peer the right-most hop that isn't trusted, the left-most where all are, the
    peer where a hop can't be read; null where the peer itself can't. IPv4 and IPv6 take the same expressions, in one scan."""
    hops = IP.addresses(F.transform(F.split("forwarded", ","), T.trim))
    x = log.withColumns({"_peer": IP.address(IP.peer_host(F.col("remote"))), "_hops": F.when(T.trim(F.col("forwarded")) != "", hops)})
    outside = F.filter("_hops", lambda h: ~IP.is_within(h, trusted))
    through = F.when(F.exists("_hops", lambda h: h.isNull()), F.col("_peer")).otherwise(F.coalesce(F.try_element_at(outside, F.lit(-1)), F.col("_hops")[0]))
    chosen = F.when(IP.is_within(F.col("_peer"), trusted) & F.col("_hops").isNotNull(), through).otherwise(F.col("_peer"))
    return x.withColumn("_client", chosen).withColumn("client", IP.spelled(F.col("_client"))).drop("_peer", "_hops", "_client")


def pseudonym(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, from two digests."""
    import hashlib

    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ p for x in k).hex())) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, c.cast("binary")), 256))), 256)


def error_report(errors: DataFrame) -> DataFrame:
    """status, code, retry_seconds, n of errors(cause); causes that aren't listed are internal."""
    spark = errors.sparkSession
    codes = spark.createDataFrame(list(ERRORS), "cause string, status int, code string, retry_seconds int")
    known = F.when(F.col("cause").isin(*[c for c, *_ in ERRORS]), F.col("cause")).otherwise("internal")
    return errors.withColumn("cause", known).join(F.broadcast(codes), "cause").groupBy("status", "code", "retry_seconds").agg(F.count("*").alias("n"))  # eight rows


#: What is not global unicast, private, or shared by carriers.
BLOCKED = (
    "0.0.0.0/32", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "255.255.255.255/32",
    "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
)


def audit_urls(urls: DataFrame, allow_http: bool = False) -> DataFrame:
    """urls(url) with reject_code, null where the URL may be fetched; names are not looked up. The first that holds decides: invalid (control
    characters, a bad host, port or escape), no_host, userinfo, scheme, port, address (a literal that is blocked, IPv4-mapped or has a zone)."""
    u = F.col("url")
    main = F.substring_index(u, "#", 1)
    scheme = F.lower(F.regexp_extract(main, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(main, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    x = urls.withColumns({"_scheme": scheme, "_authority": authority, "_host": F.substring_index(authority, "@", -1), "_path": F.substring_index(F.regexp_replace(main, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", ""), "?", 1)})
    h = F.col("_host")
    bracketed = h.startswith("[")
    # in brackets up to the last one, else up to the last colon; a port is digits, or none
    x = x.withColumns({"_name": F.when(bracketed, F.regexp_extract(h, "^\\[(.*)\\](?::[0-9]*)?$", 1)).otherwise(F.regexp_extract(h, "^(.*?)(?::[0-9]*)?$", 1)), "_port": F.regexp_extract(h, ":([0-9]*)$", 1), "_inside": bracketed})
    name = F.col("_name")
    literal = F.when(F.col("_inside"), F.replace(name, F.lit("%25"), F.lit("%"))).otherwise(name)
    x = x.withColumn("_ip", IP.address(literal))
    escape = "%(?![0-9A-Fa-f]{2})"
    bad_host = F.when(F.col("_inside"), (name == "") | F.col("_ip").isNull() | ~F.contains(name, F.lit(":"))).otherwise(F.contains(name, F.lit(":")) | name.rlike(r"[\x00-\x20\\^`{|}\x7F\[\]]|" + escape + "|%[0-7](?<!%2)|%2(?!5)"))
    invalid = u.rlike("[\\x00-\\x1F\\x7F]") | (F.col("_authority") != "") & bad_host | F.col("_path").rlike(escape) | F.substring(u, F.length(main) + 2, F.lit(1 << 30)).rlike(escape)
    number, ip = F.col("_port").try_cast("int"), F.col("_ip")
    mapped = F.contains(name, F.lit(":")) & ip["digits"].startswith(IP.MAPPED)
    code = (
        F.when(invalid, "invalid").when(u.isNull() | (name == ""), "no_host").when(F.contains("_authority", F.lit("@")), "userinfo")
        .when(~(F.col("_scheme").isin("https", "http") if allow_http else F.col("_scheme") == "https"), "scheme")
        .when((F.col("_port") != "") & ~number.eqNullSafe(F.when(F.col("_scheme") == "https", 443).otherwise(80)), "port")
        .when(F.coalesce(mapped | ip["zone"].isNotNull() | IP.is_within(ip, BLOCKED), F.lit(False)), "address")
    )
    return x.select(*urls.columns, code.alias("reject_code"))


def audit_origins(log: DataFrame, public_origin: str) -> DataFrame:
    """log(origin) with origin_ok: absent, or scheme and host only and the expected one."""
    o = F.col("origin")
    ok = o.rlike("(?i)^https?://[^/?#@]+$") & (F.lower(o) == public_origin.lower())
    return log.withColumn("origin_ok", F.when(o.isNull() | (o == ""), True).otherwise(ok))


def clean_names(df: DataFrame, column: str = "name") -> DataFrame:
    """df with display_name: percent-decoded, last path part, control characters off, 180 characters at most, else novel.txt."""
    raw = F.replace(F.col(column), F.lit("+"), F.lit("%2B"))
    decoded = F.coalesce(F.try_url_decode(raw), F.col(column))
    last = F.regexp_extract(F.replace(decoded, F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1)
    clean = F.left(F.trim(F.regexp_replace(last, "[\\x00-\\x1F\\x7F]", "")), F.lit(180))
    return df.withColumn("display_name", F.coalesce(F.nullif(clean, F.lit("")), F.lit("novel.txt")))

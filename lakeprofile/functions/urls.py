"""Storage URLs: which store, which container, which object."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakeprofile.functions.lookup import as_column, look_up

# URL scheme -> scheme of the target's external data source (fixed values): for the 2019 release, then later ones.
SCHEMES_2019 = {
    "abs": "wasbs",
    "wasb": "wasbs",
    "wasbs": "wasbs",
    "adls": "abfss",
    "abfs": "abfss",
    "abfss": "abfss",
}
SCHEMES_LATER = {
    "abs": "abs",
    "wasb": "abs",
    "wasbs": "abs",
    "adls": "adls",
    "abfs": "adls",
    "abfss": "adls",
}
# Schemes of readers and of users for the two remote stores (fixed values).
S3_SCHEMES = ["s3", "s3a", "s3n"]
AZURE_SCHEMES = ["azure", "abfs", "abfss", "wasb", "wasbs"]
PLACEHOLDER_2019 = "wasbs://<container>@<storage_account>.blob.core.windows.net"
PLACEHOLDER_LATER = "adls://<container>@<storage_account>.dfs.core.windows.net"


def scheme_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_column(url), "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def authority_of(url: Column | str) -> Column:
    return F.regexp_extract(as_column(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host_of(url: Column | str) -> Column:
    """Host without user part and port."""
    return F.lower(F.regexp_extract(authority_of(url), "^(?:.*@)?([^:@]*)", 1))


def path_of(url: Column | str) -> Column:
    """Path part, without query and fragment."""
    return F.regexp_extract(as_column(url), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def percent_decode(text: Column | str) -> Column:
    """Percent escapes decoded, plus signs kept; null where an escape is malformed."""
    return F.try_url_decode(F.replace(as_column(text), F.lit("+"), F.lit("%2B")))


def storage_kind(url: Column | str) -> Column:
    """``s3``, ``azure`` or ``local``. A host that only looks like a blob host is local."""
    scheme = scheme_of(url)
    blob_host = host_of(url).endswith(".blob.core.windows.net")
    return (
        F.when(scheme.isin(*S3_SCHEMES), "s3")
        .when(scheme.isin(*AZURE_SCHEMES) | ((scheme == "https") & blob_host), "azure")
        .otherwise("local")
    )


def connection_key(url: Column | str) -> Column:
    """One key per account: remote scheme and authority, or ``local``."""
    remote = F.concat(scheme_of(url), F.lit("://"), F.lower(authority_of(url)))
    return F.when(storage_kind(url) == "local", "local").otherwise(remote)


def location_name(url: Column | str) -> Column:
    """Last path component; decoded for remote objects."""
    url = as_column(url)
    remote = F.regexp_extract(percent_decode(F.rtrim(path_of(url), F.lit("/"))), "([^/]*)$", 1)
    return F.when(storage_kind(url) == "local", F.regexp_extract(url, "([^/]*)$", 1)).otherwise(remote)


def object_address(url: Column | str, require_key: bool = False) -> Column:
    """Struct ``container, key, error`` of an s3://, azure:// or blob-host https:// URL."""
    url = as_column(url)
    scheme = scheme_of(url)
    path = F.ltrim(path_of(url), F.lit("/"))
    split_path = scheme == "https"
    container = F.when(split_path, percent_decode(F.regexp_extract(path, "^([^/]*)", 1))).otherwise(authority_of(url))
    key = percent_decode(F.when(split_path, F.regexp_extract(path, "^[^/]*/(.*)$", 1)).otherwise(path))
    error = (
        F.when(~scheme.isin("s3", "azure", "https"), "unsupported scheme")
        .when(split_path & ~host_of(url).endswith(".blob.core.windows.net"), "not a blob storage host")
        .when(F.coalesce(container, F.lit("")) == "", "missing container")
        .when(key.isNull(), "malformed escape")
    )
    if require_key:
        error = error.when(key == "", "missing key")
    valid = error.isNull()
    return F.struct(F.when(valid, container).alias("container"), F.when(valid, key).alias("key"),
                    error.alias("error"))


def data_source_address(url: Column | str, file_name: Column | str, platform: str) -> Column:
    """Struct ``location, relative_path`` for an external data source on ``platform``."""
    old = platform == "sql_server_2019"
    placeholder = F.lit(PLACEHOLDER_2019 if old else PLACEHOLDER_LATER)
    url = F.replace(F.trim(as_column(url)), F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(F.replace(as_column(file_name), F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    name = F.when(name == "", "<file>").otherwise(name)

    scheme, authority = scheme_of(url), authority_of(url)
    path = F.btrim(path_of(url), F.lit("/"))
    first = F.regexp_extract(path, "^([^/]*)", 1)
    rest = F.regexp_extract(path, "^[^/]*/(.*)$", 1)

    def or_name(part: Column) -> Column:
        return F.when(part == "", name).otherwise(part)

    def address(location: Column, relative: Column) -> Column:
        return F.struct(location.alias("location"), relative.alias("relative_path"))

    target = look_up(scheme, SCHEMES_2019 if old else SCHEMES_LATER)
    container_in_path = ~authority.contains("@") & (path != "")
    hadoop_host = F.when(container_in_path, F.concat(first, F.lit("@"), authority)).otherwise(authority)
    hadoop_path = F.when(container_in_path, rest).otherwise(path)

    host = F.lower(authority)
    https_target = F.when(host.endswith(".dfs.core.windows.net"), "abfss" if old else "adls").when(
        host.endswith(".blob.core.windows.net"), "wasbs" if old else "abs"
    )
    https_host = F.when(first == "", authority).otherwise(F.concat(first, F.lit("@"), authority))

    has_host = authority != ""
    result = (
        F.when((F.coalesce(url, F.lit("")) == ""), address(placeholder, F.concat(F.lit("<path>/"), name)))
        .when(target.isNotNull() & has_host,
              address(F.concat(target, F.lit("://"), hadoop_host), or_name(hadoop_path)))
        .when((scheme == "https") & has_host & https_target.isNull(), address(placeholder, or_name(path)))
        .when((scheme == "https") & has_host,
              address(F.concat(https_target, F.lit("://"), https_host), or_name(rest)))
    )
    if not old:
        result = result.when((scheme == "s3") & has_host,
                             address(F.concat(F.lit("s3://"), authority), or_name(path)))
    return result.otherwise(address(placeholder, or_name(F.ltrim(url, F.lit("/")))))

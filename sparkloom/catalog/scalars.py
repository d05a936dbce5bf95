"""Scalar functions by family, many to a query."""

from __future__ import annotations

from .common import Registry

QUERIES = Registry()
P = QUERIES.projection

# ---- conditional, null, literal, cast
P("cond_basic", "customer", ["c_custkey"], [
    ("band", "CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END"),
    ("only_if", "CASE WHEN c_acctbal > 9000 THEN c_name END"),
    ("coalesced", "coalesce(CASE WHEN c_acctbal > 9000 THEN c_name END, c_mktsegment)"),
    ("nvl_", "nvl(CASE WHEN c_acctbal > 9000 THEN c_name END, 'none')", "coalesce(CASE WHEN c_acctbal > 9000 THEN c_name END, 'none')"),
    ("ifnull_", "ifnull(nullif(c_mktsegment, 'BUILDING'), 'was building')"),
    ("nullif_", "nullif(c_mktsegment, 'BUILDING')"),
    ("nvl2_", "nvl2(nullif(c_mktsegment, 'BUILDING'), 'set', 'unset')", "CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NOT NULL THEN 'set' ELSE 'unset' END"),
    ("is_null", "isnull(nullif(c_mktsegment, 'BUILDING'))", "nullif(c_mktsegment, 'BUILDING') IS NULL"),
    ("is_not_null", "isnotnull(nullif(c_mktsegment, 'BUILDING'))", "nullif(c_mktsegment, 'BUILDING') IS NOT NULL"),
    ("greatest_", "greatest(c_nationkey, 10, 3)"),
    ("least_", "least(c_nationkey, 10, 3)"),
    ("same", "equal_null(nullif(c_nationkey, 3), null)", "nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL"),
    ("null_safe", "nullif(c_nationkey, 3) <=> c_nationkey", "nullif(c_nationkey, 3) IS NOT DISTINCT FROM c_nationkey"),
    ("in_list", "c_nationkey IN (1, 5, 7)"),
    ("in_text", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("between_", "c_nationkey BETWEEN 5 AND 10"),
    ("not_", "NOT (c_nationkey > 5) OR c_acctbal < 0"),
    ("nan_", "nanvl(CASE WHEN c_nationkey = 3 THEN double('NaN') ELSE c_acctbal END, -1D)", "CASE WHEN c_nationkey = 3 THEN -1.0::DOUBLE ELSE c_acctbal END"),
    ("is_nan", "isnan(CASE WHEN c_nationkey = 3 THEN double('NaN') ELSE c_acctbal END)", "isnan(CASE WHEN c_nationkey = 3 THEN 'NaN'::DOUBLE ELSE c_acctbal END)"),
])
P("cast_family", "orders", ["o_orderkey"], [
    ("as_string", "cast(o_orderkey as string)", "cast(o_orderkey as varchar)"),
    ("as_int", "cast(o_orderkey as int)"),
    ("trunc_int", "cast(o_totalprice as bigint)", "cast(trunc(o_totalprice) as bigint)"),
    ("as_double", "cast(o_orderkey as double)"),
    ("as_date", "cast(o_orderdate as date)"),
    ("date_text", "cast(cast(o_orderdate as date) as string)", "cast(cast(o_orderdate as date) as varchar)"),
    ("as_bool", "cast(o_orderkey % 2 as boolean)"),
    ("bad_text", "try_cast(o_orderstatus as int)"),
    ("good_text", "try_cast(concat('1', cast(o_orderkey as string)) as bigint)", "try_cast(concat('1', cast(o_orderkey as varchar)) as bigint)"),
    ("bool_text", "cast(o_orderstatus = 'F' as string)", "cast(o_orderstatus = 'F' as varchar)"),
    ("small", "cast(o_orderkey % 100 as smallint)"),
    ("from_text", "cast('2024-02-29' as date)"),
])
# ---- strings
P("string_basic", "part", ["p_partkey"], [
    ("up", "upper(p_name)"), ("low", "lower(p_type)"), ("ucase_", "ucase(p_brand)"), ("lcase_", "lcase(p_brand)"),
    ("len", "cast(length(p_name) as int)"), ("clen", "cast(char_length(p_name) as int)", "cast(length(p_name) as int)"),
    ("bits", "cast(bit_length(p_name) as int)"), ("octets", "cast(octet_length(p_name) as int)", "cast(octet_length(encode(p_name)) as int)"),
    ("sub", "substring(p_name, 2, 4)"), ("sub_neg", "substring(p_name, -3, 2)"), ("substr_", "substr(p_name, 3)"),
    ("left_", "left(p_name, 3)"), ("right_", "right(p_name, 3)"),
    ("trimmed", "trim(concat('  ', p_brand, ' '))"), ("ltrimmed", "ltrim(concat('  ', p_brand))"), ("rtrimmed", "rtrim(concat(p_brand, '  '))"),
    ("btrimmed", "btrim(concat('xx', p_brand, 'x'), 'x')", "trim(concat('xx', p_brand, 'x'), 'x')"),
    ("cat", "concat(p_brand, '-', p_type)"), ("cat_ws", "concat_ws('|', p_brand, nullif(p_type, p_type), p_name)"),
    ("rep", "repeat(left(p_brand, 2), 3)"), ("rev", "reverse(p_name)"), ("lp", "lpad(p_brand, 12, '*')"), ("rp", "rpad(p_brand, 12, '*')"),
    ("lp_cut", "lpad(p_name, 4, '*')"), ("tr", "translate(p_name, 'aeiou', 'AEI')"), ("repl", "replace(p_type, 'E', 'e')"),
    ("asc", "ascii(p_name)"), ("chr_", "chr(cast(65 + p_partkey % 26 as int))"),
])
P("string_search", "part", ["p_partkey"], [
    ("loc", "cast(locate('e', p_name) as int)", "cast(instr(p_name, 'e') as int)"),
    ("ins", "cast(instr(p_name, 'o') as int)"), ("pos", "cast(position('r' IN p_name) as int)"),
    ("starts", "startswith(p_type, 'S')", "starts_with(p_type, 'S')"), ("ends", "endswith(p_type, 'L')", "suffix(p_type, 'L')"),
    ("has", "contains(p_type, 'TIN')"), ("lk", "p_type LIKE '%BRASS'"), ("lk_one", "p_brand LIKE 'Brand#1_'"),
    ("lk_esc", "concat(p_brand, '%') LIKE '%!%' ESCAPE '!'"), ("ilk", "p_type ILIKE '%brass'"),
    ("rl", "p_name RLIKE '^[a-m]'", "regexp_matches(p_name, '^[a-m]')"), ("rx_like", "regexp_like(p_type, 'T.N')", "regexp_matches(p_type, 'T.N')"),
    ("rx_ext", "regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2)", "regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2)"),
    ("rx_none", "regexp_extract(p_brand, 'zzz', 0)"), ("rx_rep", "regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
    ("rx_count", "cast(regexp_count(p_name, '[aeiou]') as int)", "cast(len(regexp_extract_all(p_name, '[aeiou]')) as int)"),
    ("rx_all", "array_join(regexp_extract_all(p_name, '([a-z])e', 1), ',')", "array_to_string(regexp_extract_all(p_name, '([a-z])e', 1), ',')"),
    ("part1", "split_part(p_brand, '#', 1)"), ("part2", "split_part(p_brand, '#', 2)"), ("idx", "substring_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"),
    ("words", "cast(size(split(p_name, ' ')) as int)", "cast(len(string_split_regex(p_name, ' ')) as int)"),
    ("lev", "cast(levenshtein(p_brand, p_type) as int)"), ("in_set", "find_in_set(p_brand, 'Brand#11,Brand#12,Brand#13')", "coalesce(list_position(['Brand#11', 'Brand#12', 'Brand#13'], p_brand), 0)::INT"), ("over", "overlay(p_brand PLACING 'XX' FROM 2 FOR 3)", "left(p_brand, 1) || 'XX' || substring(p_brand, 5)"),
])
P("string_encoding", "part", ["p_partkey"], [
    ("md", "md5(p_name)"), ("s1", "sha1(p_name)", "sha1(p_name)"), ("s256", "sha2(p_name, 256)", "sha256(p_name)"),
    ("b64", "base64(p_name)", "to_base64(encode(p_name))"), ("unb", "cast(unbase64(base64(p_name)) as string)", "p_name"),
    ("hx", "hex(p_name)", "hex(p_name)"), ("unhx", "cast(unhex(hex(p_name)) as string)", "p_name"), ("bin_", "bin(p_partkey)", "to_binary(p_partkey)"),
    ("hxn", "hex(p_partkey)", "to_hex(p_partkey)"), ("url_d", "url_decode(concat(p_brand, '%2Fb'))", "concat(p_brand, '/b')"), ("enc_len", "cast(length(encode(p_name, 'UTF-8')) as int)", "cast(octet_length(encode(p_name)) as int)"),
    ("dec", "decode(encode(p_name, 'UTF-8'), 'UTF-8')", "p_name"), ("ell", "elt(cast(1 + p_partkey % 3 as int), 'x', 'y', 'z')", "list_extract(['x','y','z'], cast(1 + p_partkey % 3 as int))"),
    ("fmt", "format_string('%s-%05d', p_brand, p_partkey)", "format('{}-{:05d}', p_brand, p_partkey)"), ("prf", "printf('%d/%s', p_size, p_brand)", "printf('%d/%s', p_size, p_brand)"),
    ("host", "parse_url(concat('http://h', cast(p_partkey as string), '.example/p?q=1'), 'HOST')", "concat('h', cast(p_partkey as varchar), '.example')"),
    ("q", "parse_url(concat('http://h/p?q=7&r=', cast(p_size as string)), 'QUERY', 'r')", "cast(p_size as varchar)"),
])
# Functions that DuckDB lacks or computes otherwise: tests hold them against fixed values.
P("string_spark_only", "part", ["p_partkey"], [
    ("snd", "soundex(p_name)", None), ("cap", "initcap(p_name)"), ("msk", "mask(p_brand)"), ("cnv", "conv(cast(p_partkey as string), 10, 16)"),
    ("crc", "crc32(p_name)"), ("xx", "xxhash64(p_name)"), ("hsh", "hash(p_name)"), ("url_e", "url_encode(p_name)"), ("num", "format_number(p_retailprice, 2)"),
    ("to_c", "to_char(p_size, '999')"), ("to_n", "to_number('12', '99')"), ("try_n", "try_to_number('x', '99')"), ("rx_in", "regexp_instr(p_name, 'e')"), ("rx_sub", "regexp_substr(p_name, 'e.')"),
    ("aes", "cast(aes_decrypt(aes_encrypt(p_name, '0123456789abcdef'), '0123456789abcdef') as string)"), ("try_aes", "try_aes_decrypt(unhex('00'), '0123456789abcdef')"),
    ("to_b", "to_binary('ab', 'utf-8')"), ("try_b", "try_to_binary('zz', 'hex')"), ("to_vc", "to_varchar(p_size, '999')"),
])
# ---- math


def R(spark: str, duck: str | None = None) -> tuple[str, str]:  # noqa: N802
    """To the nearest millionth, for each engine, in plain double arithmetic; round(x, 6) goes through decimals row by row."""
    return f"rint(({spark}) * 1e6D) / 1e6D", f"round_even(({duck or spark})::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE"


P("math_basic", "lineitem", ["l_orderkey", "l_linenumber"], [
    ("ab", "abs(l_discount - 0.05D)", "abs(l_discount - 0.05::DOUBLE)"), ("ce", "cast(ceil(l_extendedprice) as bigint)"), ("fl", "cast(floor(l_extendedprice) as bigint)"),
    ("rd", "round(l_extendedprice * 1.0D, 1)", "round(l_extendedprice, 1)"), ("sq", *R("sqrt(l_quantity)")), ("cb", *R("cbrt(l_quantity)")), ("pw", *R("pow(l_quantity, 2)")), ("pwr", *R("power(l_tax, 3)")),
    ("ex", *R("exp(l_discount)")), ("em", *R("expm1(l_discount)", "exp(l_discount) - 1")), ("lg", *R("ln(l_quantity)")), ("lgb", *R("log(3, l_quantity)", "ln(l_quantity) / ln(3)")), ("l10", *R("log10(l_quantity)")), ("l2", *R("log2(l_quantity)")), ("l1p", *R("log1p(l_tax)", "ln(1 + l_tax)")),
    ("sg", "signum(l_discount - 0.05D)", "cast(sign(l_discount - 0.05::DOUBLE) as double)"), ("neg", "negative(l_quantity)", "-l_quantity"), ("pos", "positive(l_tax)", "l_tax"),
    ("md", "l_orderkey % 7"), ("pm", "pmod(-l_orderkey, 7)", "(7 - l_orderkey % 7) % 7"), ("dv", *R("l_extendedprice / l_quantity")), ("idiv", "l_orderkey div 4", "l_orderkey // 4"),
    ("try_d", "try_divide(l_quantity, 0D)", "cast(NULL as double)"), ("try_a", "try_add(l_orderkey, 1)", "l_orderkey + 1"), ("try_s", "try_subtract(l_orderkey, 1)", "l_orderkey - 1"), ("try_m", "try_multiply(l_orderkey, 2)", "l_orderkey * 2"),
    ("hy", *R("hypot(l_quantity, 3D)", "sqrt(l_quantity * l_quantity + 9)")), ("fact", "factorial(cast(l_linenumber as int))", "cast(factorial(l_linenumber) as bigint)"),
])
P("math_trig", "lineitem", ["l_orderkey", "l_linenumber"], [
    ("si", *R("sin(l_quantity)")), ("co", *R("cos(l_quantity)")), ("ta", *R("tan(l_discount)")), ("ct", *R("cot(l_discount + 1)")), ("sc", *R("sec(l_discount)", "1 / cos(l_discount)")), ("cs", *R("csc(l_discount + 1)", "1 / sin(l_discount + 1)")),
    ("asi", *R("asin(l_discount)")), ("aco", *R("acos(l_discount)")), ("ata", *R("atan(l_quantity)")), ("at2", *R("atan2(l_quantity, l_tax + 1)")),
    ("sih", *R("sinh(l_discount)")), ("coh", *R("cosh(l_discount)")), ("tah", *R("tanh(l_discount)")), ("ash", *R("asinh(l_quantity)")), ("ach", *R("acosh(l_quantity)")), ("ath", *R("atanh(l_discount)")),
    ("deg", *R("degrees(l_discount)")), ("rad", *R("radians(l_quantity)")), ("pi_", *R("pi()")), ("e_", *R("e()", "exp(1.0::DOUBLE)")), ("ri", "rint(l_extendedprice)", "round_even(l_extendedprice, 0)"),
])
P("math_bits", "orders", ["o_orderkey"], [
    ("ba", "o_orderkey & 12"), ("bo", "o_orderkey | 12"), ("bx", "o_orderkey ^ 12", "xor(o_orderkey, 12)"), ("bn", "~o_orderkey"), ("bc", "cast(bit_count(o_orderkey) as int)"),
    ("sl", "shiftleft(o_orderkey, 3)", "o_orderkey << 3"), ("sr", "shiftright(o_orderkey, 2)", "o_orderkey >> 2"), ("sru", "shiftrightunsigned(o_orderkey, 2)", "o_orderkey >> 2"),
    ("gb", "cast(getbit(o_orderkey, 1) as int)", "cast((o_orderkey >> 1) & 1 as int)"), ("bp", "bitmap_bit_position(o_orderkey)", "(o_orderkey - 1) % 32768"), ("bb", "bitmap_bucket_number(o_orderkey)", "(o_orderkey - 1) // 32768 + 1"),
    ("wb", "cast(width_bucket(o_totalprice, 0, 500000, 10) as bigint)", "cast(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11 ELSE floor(o_totalprice / 50000) + 1 END as bigint)"),
], where=("o_orderkey > 0", "o_orderkey > 0"))
# ---- dates and times
D = "cast(o_orderdate as date)"
P("date_parts", "orders", ["o_orderkey"], [
    ("y", "year(o_orderdate)", "cast(year(o_orderdate) as int)"), ("mo", "month(o_orderdate)", "cast(month(o_orderdate) as int)"), ("dy", "day(o_orderdate)", "cast(day(o_orderdate) as int)"), ("dom", "dayofmonth(o_orderdate)", "cast(day(o_orderdate) as int)"),
    ("dow", "dayofweek(o_orderdate)", "cast(dayofweek(o_orderdate) + 1 as int)"), ("doy", "dayofyear(o_orderdate)", "cast(dayofyear(o_orderdate) as int)"), ("wd", "weekday(o_orderdate)", "cast(isodow(o_orderdate) - 1 as int)"), ("wk", "weekofyear(o_orderdate)", "cast(weekofyear(o_orderdate) as int)"),
    ("qt", "quarter(o_orderdate)", "cast(quarter(o_orderdate) as int)"), ("hr", "hour(o_orderdate)", "cast(hour(o_orderdate) as int)"), ("mi", "minute(o_orderdate)", "cast(minute(o_orderdate) as int)"), ("se", "second(o_orderdate)", "cast(second(o_orderdate) as int)"),
    ("ex", "extract(YEAR FROM o_orderdate)", "cast(extract(YEAR FROM o_orderdate) as int)"), ("dp", "date_part('month', o_orderdate)", "cast(date_part('month', o_orderdate) as int)"), ("dn", "dayname(o_orderdate)", "left(dayname(o_orderdate), 3)"),
])
P("date_arithmetic", "orders", ["o_orderkey"], [
    ("plus", f"date_add({D}, 10)", f"{D} + 10"), ("minus", f"date_sub({D}, 10)", f"{D} - 10"), ("dif", f"datediff({D}, DATE '1995-01-01')", f"cast({D} - DATE '1995-01-01' as int)"), ("dif2", f"date_diff(DATE '2000-01-01', {D})", f"cast(DATE '2000-01-01' - {D} as int)"),
    ("am", f"add_months({D}, 1)", f"cast({D} + INTERVAL 1 MONTH as date)"), ("ld", f"last_day({D})"), ("tr_m", f"trunc({D}, 'MM')", f"cast(date_trunc('month', {D}) as date)"), ("tr_y", f"trunc({D}, 'YEAR')", f"cast(date_trunc('year', {D}) as date)"), ("tr_q", f"trunc({D}, 'QUARTER')", f"cast(date_trunc('quarter', {D}) as date)"), ("tr_w", f"trunc({D}, 'WEEK')", f"cast(date_trunc('week', {D}) as date)"),
    ("dt_h", "cast(date_trunc('HOUR', o_orderdate) as timestamp_ntz)", "date_trunc('hour', o_orderdate)"), ("ud", f"unix_date({D})", f"cast({D} - DATE '1970-01-01' as int)"), ("fud", "date_from_unix_date(cast(o_orderkey % 1000 as int))", "DATE '1970-01-01' + cast(o_orderkey % 1000 as int)"),
    ("mk", "make_date(1990 + cast(o_orderkey % 10 as int), 2, 3)", "make_date(1990 + o_orderkey % 10, 2, 3)"), ("us", "unix_timestamp(cast(o_orderdate as timestamp))", "cast(epoch(o_orderdate) as bigint)"), ("fm", f"date_format({D}, 'yyyy/MM/dd')", f"strftime({D}, '%Y/%m/%d')"), ("td", f"to_date(cast({D} as string))", D), ("tdf", f"to_date(date_format({D}, 'dd/MM/yyyy'), 'dd/MM/yyyy')", D),
    ("nd", f"next_day({D}, 'MON')", f"cast({D} + cast(8 - isodow({D}) as int) as date)"), ("iv", "cast(o_orderdate + INTERVAL '2' DAY as timestamp_ntz)", "o_orderdate + INTERVAL 2 DAY"),
    ("tsd", f"timestampdiff(MONTH, TIMESTAMP '1990-01-01 00:00:00', cast({D} as timestamp))", f"cast(datesub('month', TIMESTAMP '1990-01-01', cast({D} as timestamp)) as bigint)"), ("tsa", f"cast(timestampadd(MONTH, 1, cast({D} as timestamp_ntz)) as date)", f"cast({D} + INTERVAL 1 MONTH as date)"),
])
P("date_epoch", "events", ["event_id"], [
    ("sec", "unix_seconds(cast(ts as timestamp))", "cast(floor(epoch(ts)) as bigint)"), ("ms", "unix_millis(cast(ts as timestamp))", "epoch_us(ts) // 1000"), ("us", "unix_micros(cast(ts as timestamp))", "epoch_us(ts)"),
    ("back", "cast(timestamp_seconds(unix_seconds(cast(ts as timestamp))) as timestamp_ntz)", "date_trunc('second', ts)"), ("back_ms", "cast(timestamp_millis(unix_millis(cast(ts as timestamp))) as timestamp_ntz)", "date_trunc('milliseconds', ts)"), ("back_us", "cast(timestamp_micros(unix_micros(cast(ts as timestamp))) as timestamp_ntz)", "ts"),
    ("txt", "from_unixtime(unix_seconds(cast(ts as timestamp)))", "strftime(ts, '%Y-%m-%d %H:%M:%S')"), ("parsed", "to_timestamp_ntz(date_format(ts, 'yyyy-MM-dd HH:mm:ss'))", "date_trunc('second', ts)"), ("bad", "cast(try_to_timestamp(event_type) as timestamp_ntz)", "try_cast(event_type as timestamp)"),
    ("mts", "make_timestamp_ntz(year(ts), month(ts), day(ts), hour(ts), minute(ts), 5.0)", "make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 5.0)"),
])
P("date_spark_only", "events", ["event_id"], [
    ("mb", "months_between(DATE '2024-03-31', DATE '2024-02-29')", None), ("fu", "from_utc_timestamp(ts, 'Asia/Tokyo')"), ("tu", "to_utc_timestamp(ts, 'Asia/Tokyo')"), ("cz", "convert_timezone('UTC', 'Asia/Tokyo', ts)"),
    ("dt", "cast(make_dt_interval(1, 2, 3, 4.5) as string)"), ("ym", "cast(make_ym_interval(1, 2) as string)"), ("tz", "current_timezone()"),
])

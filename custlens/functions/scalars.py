"""Scalar column functions (F01-F21), all Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- F01-F04: dates ----------------------------------------------------------

# Accepted registration-date layouts, in priority order
# (day-first before month-first).
DATE_LAYOUTS = [
    (r"^\d{4}-\d{2}-\d{2}$", ["yyyy-MM-dd"]),
    (r"^\d{2}/\d{2}/\d{4}$", ["dd/MM/yyyy", "MM/dd/yyyy"]),
    (r"^\d{2}/\d{2}/\d{2}$", ["dd/MM/yy", "MM/dd/yy"]),
]


def parse_mixed_date(c: Column | str) -> Column:
    """day-first parse of mixed layouts; unparsable -> null.  The layout
    is chosen by the string's shape first, so it never depends on row order."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c)
    out = None
    for regex, fmts in DATE_LAYOUTS:
        parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in fmts]) if len(fmts) > 1 \
            else F.try_to_timestamp(s, F.lit(fmts[0]))
        out = F.when(s.rlike(regex), parsed) if out is None else out.when(s.rlike(regex), parsed)
    return F.to_date(out)


def date_parts(df: DataFrame, col: str = "RegistrationDate", prefix: str = "Reg") -> DataFrame:
    """year, month, day, weekday (0 = Monday); the source column is dropped."""
    d = parse_mixed_date(col)
    return (df.withColumn("_d", d)
              .withColumns({f"{prefix}Year": F.year("_d").cast("bigint"),
                            f"{prefix}Month": F.month("_d").cast("bigint"),
                            f"{prefix}Day": F.dayofmonth("_d").cast("bigint"),
                            f"{prefix}Weekday": F.weekday("_d").cast("bigint")})
              .drop("_d", col))


def parse_failures(df: DataFrame, col: str = "RegistrationDate") -> DataFrame:
    """number of values that do not parse (nulls included)."""
    return df.agg(F.count_if(parse_mixed_date(col).isNull()).cast("bigint").alias("n_failed"))


def date_format_class(c: Column | str) -> Column:
    """token-length classification of a date string."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, "/")
    first_len = F.length(F.element_at(parts, 1))
    third_len = F.length(F.element_at(parts, 3))
    slash = (F.when(F.size(parts) < 3, F.lit("Other"))
              .when((third_len == 2) & (first_len == 2), F.lit("DD/MM/YY"))
              .when((third_len == 4) & (first_len == 2), F.lit("MM/DD/YYYY"))
              .otherwise(F.lit("Other")))
    return (F.when(c.isNull(), F.lit(None).cast("string"))
             .when(c.contains("/"), slash)
             .when(c.contains("-"), F.lit("YYYY-MM-DD"))
             .otherwise(F.lit(None).cast("string")))


def date_format_profile(df: DataFrame, col: str = "RegistrationDate") -> DataFrame:
    """distribution of layouts; strings with neither separator are not counted."""
    total = df.count()
    return (df.select(date_format_class(col).alias("date_format"))
              .where(F.col("date_format").isNotNull())
              .groupBy("date_format").agg(F.count(F.lit(1)).alias("n_rows"))
              .withColumn("pct", round_even(F.col("n_rows") * 100.0 / F.lit(total), 6)))


# --- F05-F06: IP addresses ---------------------------------------------------

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def _ipv4_private(c: Column) -> Column:
    o = [F.split(c, r"\.").getItem(i).cast("int") for i in range(4)]
    o1, o2, o3, o4 = o
    # IPv4 blocks the standard library reports as private.
    return (
        (o1 == 0) | (o1 == 10) | (o1 == 127)
        | ((o1 == 169) & (o2 == 254))
        | ((o1 == 172) & (o2 >= 16) & (o2 <= 31))
        | ((o1 == 192) & (o2 == 0) & (o3 == 0) & ~o4.isin(9, 10))
        | ((o1 == 192) & (o2 == 0) & (o3 == 2))
        | ((o1 == 192) & (o2 == 168))
        | ((o1 == 198) & o2.isin(18, 19))
        | ((o1 == 198) & (o2 == 51) & (o3 == 100))
        | ((o1 == 203) & (o2 == 0) & (o3 == 113))
        | (o1 >= 240)
    )


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ipv6_groups(c: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address, null where the text is none.
    A scope after % is allowed; the last 32 bits may be written as IPv4."""
    addr = F.when(c.rlike(r"^[^%/]+(%[^%/]+)?$"), F.split_part(c, F.lit("%"), F.lit(1)))
    tail = F.regexp_extract(addr, r"([^:]*)$", 1)
    o = [F.split_part(tail, F.lit("."), F.lit(i)).try_cast("int") for i in range(1, 5)]
    tail_hex = F.concat(F.hex(o[0] * 256 + o[1]), F.lit(":"), F.hex(o[2] * 256 + o[3]))
    text = (F.when(~tail.contains("."), addr)
             .when(tail.rlike(IPV4_RE), F.concat(F.substring(addr, F.lit(1), F.length(addr) - F.length(tail)), tail_hex)))

    def groups(t: Column) -> Column:
        def numbers(part: Column) -> Column:
            return F.when(part == "", F.array().cast("array<int>")).otherwise(
                F.transform(F.split(part, ":"), lambda h: F.when(h.rlike("^[0-9A-Fa-f]{1,4}$"), F.conv(h, 16, 10).cast("int"))))

        at = F.instr(t, "::")
        left = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
        right = F.when(at > 0, F.substring(t, at + 2, F.length(t))).otherwise(F.lit(""))

        def joined(p: Column) -> Column:
            gap = F.lit(8) - F.size(p["l"]) - F.size(p["r"])
            whole = F.concat(p["l"], F.array_repeat(F.lit(0), gap), p["r"])
            ok = F.when(p["cut"], gap >= 1).otherwise(gap == 0) & ~F.exists(whole, lambda h: h.isNull())
            return F.when(ok, whole)

        return _let(F.struct(numbers(left).alias("l"), numbers(right).alias("r"), (at > 0).alias("cut")), joined)

    return F.when(text.isNotNull(), _let(text, groups))


def _ipv6_private(g: Column) -> Column:
    h = [F.get(g, F.lit(i)) for i in range(8)]
    zero = lambda n: reduce(lambda x, y: x & y, [h[i] == 0 for i in range(n)])
    v4 = F.concat_ws(".", F.floor(h[6] / 256), h[6] % 256, F.floor(h[7] / 256), h[7] % 256)
    # IPv6 blocks the standard library reports as private, and the exceptions among them.
    blocks = (
        (zero(7) & h[7].isin(0, 1))
        | ((h[0] == 0x64) & (h[1] == 0xFF9B) & (h[2] == 1))
        | ((h[0] == 0x100) & (h[1] == 0) & (h[2] == 0) & (h[3] == 0))
        | ((h[0] == 0x2001) & (h[1] <= 0x1FF))
        | ((h[0] == 0x2001) & (h[1] == 0xDB8))
        | (h[0] == 0x2002)
        | h[0].between(0xFC00, 0xFDFF)
        | h[0].between(0xFE80, 0xFEBF)
    )
    exceptions = (h[0] == 0x2001) & (
        ((h[1] == 1) & (h[2] == 0) & (h[3] == 0) & (h[4] == 0) & (h[5] == 0) & (h[6] == 0) & h[7].isin(1, 2))
        | (h[1] == 3)
        | ((h[1] == 4) & (h[2] == 0x112))
        | h[1].between(0x20, 0x2F)
        | h[1].between(0x30, 0x3F)
    )
    mapped = zero(5) & (h[5] == 0xFFFF)
    return F.when(mapped, _ipv4_private(v4)).otherwise(blocks & ~exceptions)


def ip_is_private(c: Column | str) -> Column:
    """1/0 private-address flag, null when the text is not an address."""
    c = F.col(c) if isinstance(c, str) else c
    v6 = _let(_ipv6_groups(c), lambda g: F.when(g.isNotNull(), F.when(_ipv6_private(g), 1).otherwise(0)))
    return (F.when(c.rlike(IPV4_RE), F.when(_ipv4_private(c), 1).otherwise(0))
             .when(c.contains(":"), v6)
             .cast("bigint"))


def ip_first_octet(c: Column | str) -> Column:
    """integer before the first '.', not range-checked."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.split_part(c, F.lit("."), F.lit(1))).try_cast("bigint")


def ip_features(df: DataFrame, col: str = "LastLoginIP") -> DataFrame:
    return (df.withColumns({"IP_IsPrivate": ip_is_private(col),
                            "IP_FirstOctet": ip_first_octet(col)}).drop(col))


# --- F07-F09, F12-F13: arithmetic features -----------------------------------

def avg_basket(df: DataFrame) -> DataFrame:
    """total / frequency, frequency 0 -> null."""
    return df.withColumn("AvgBasketValue", F.try_divide(
        F.col("MonetaryTotal"), F.nullif(F.col("Frequency").cast("double"), F.lit(0.0))))


def monetary_per_day(df: DataFrame) -> DataFrame:
    """total / (recency + 1)."""
    return df.withColumn("MonetaryPerDay", F.try_divide(
        F.col("MonetaryTotal"), (F.col("Recency") + 1).cast("double")))


def tenure_ratio(df: DataFrame) -> DataFrame:
    """recency / tenure, tenure 0 -> null."""
    return df.withColumn("TenureRatio", F.try_divide(
        F.col("Recency").cast("double"), F.nullif(F.col("CustomerTenureDays").cast("double"), F.lit(0.0))))


def log1p_cols(df: DataFrame, cols: list[str], floor: bool = False) -> DataFrame:
    """log(1 + x); with ``floor`` negative inputs are raised to 0 first."""
    def f(c):
        x = F.col(c).cast("double")
        if floor:
            x = F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
        return F.when(x > -1.0, F.log1p(x))
    return df.withColumns({c: f(c) for c in cols if c in df.columns})


def clip_col(c: Column, lo: float | None, hi: float | None) -> Column:
    """F13 core: null stays null (greatest/least would skip it)."""
    x = c
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    return F.when(c.isNotNull(), x)


def clip(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """clip columns to given bounds."""
    return df.withColumns({c: clip_col(F.col(c).cast("double"), lo, hi)
                           for c, (lo, hi) in bounds.items() if c in df.columns})


def round_even(c: Column | str, d: int = 2) -> Column:
    """half-even rounding as numpy does it: rint(x * 10^d) / 10^d on the
    binary value (Spark's ``bround`` instead rounds the exact decimal
    expansion, which differs on ties such as 237778.855)."""
    c = F.col(c) if isinstance(c, str) else c
    f = float(10 ** d)
    return F.rint(c.cast("double") * F.lit(f)) / F.lit(f)


# --- F10-F11: encodings -----------------------------------------------------

# Ordinal maps of the library module (English labels).
ORDINAL_MAPS_LIBRARY = {
    "AgeCategory": {"18-24": 0, "25-34": 1, "35-44": 2, "45-54": 3, "55-64": 4, "65+": 5, "Inconnu": -1},
    "SpendingCategory": {"Low": 0, "Medium": 1, "High": 2, "Very High": 3, "Inconnu": -1},
    "LoyaltyLevel": {"Bronze": 0, "Silver": 1, "Gold": 2, "Platinum": 3, "Inconnu": -1},
    "ChurnRiskCategory": {"Low": 0, "Medium": 1, "High": 2, "Very High": 3, "Inconnu": -1},
    "BasketSizeCategory": {"Small": 0, "Medium": 1, "Large": 2, "Very Large": 3, "Inconnu": -1},
    "PreferredTimeOfDay": {"Morning": 0, "Afternoon": 1, "Evening": 2, "Night": 3, "Inconnu": -1},
}

# Ordinal maps of the preprocessing notebook (French labels).
ORDINAL_MAPS_NOTEBOOK = {
    "AgeCategory": {"18-24": 0, "25-34": 1, "35-44": 2, "45-54": 3, "55-64": 4, "65+": 5, "Inconnu": -1},
    "SpendingCategory": {"Low": 0, "Medium": 1, "High": 2, "VIP": 3},
    "PreferredTimeOfDay": {"Matin": 0, "Midi": 1, "Après-midi": 2, "Soir": 3, "Nuit": 4},
    "LoyaltyLevel": {"Nouveau": 0, "Jeune": 1, "Établi": 2, "Ancien": 3, "Inconnu": -1},
    "ChurnRiskCategory": {"Faible": 0, "Moyen": 1, "Élevé": 2, "Critique": 3},
    "BasketSizeCategory": {"Petit": 0, "Moyen": 1, "Grand": 2, "Inconnu": -1},
}

# Nominal columns that are one-hot encoded, in this order.
ONE_HOT_COLS = ["RFMSegment", "CustomerType", "FavoriteSeason", "Region",
                "WeekendPreference", "ProductDiversity", "Gender", "AccountStatus"]


def ordinal_encode(df: DataFrame, maps: dict[str, dict[str, int]] = ORDINAL_MAPS_LIBRARY) -> DataFrame:
    """map labels to ranks; unknown or null -> -1."""
    repl = {}
    for c, m in maps.items():
        if c not in df.columns:
            continue
        lut = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
        repl[c] = F.coalesce(F.element_at(lut, F.col(c)), F.lit(-1)).cast("bigint")
    return df.withColumns(repl)


def one_hot_vocab(df: DataFrame, cols: list[str]) -> DataFrame:
    """Observed (column, value) pairs: one scan, one unpivot, one distinct."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull()).distinct()


def one_hot(df: DataFrame, cols: list[str] | None = None, vocab: list[tuple[str, str]] | None = None,
            max_columns: int = 10_000) -> tuple[DataFrame, list[tuple[str, str]]]:
    """one int column ``<col>_<value>`` per observed value (none dropped,
    null -> all zero), source columns dropped.  The learned vocabulary is
    returned so scoring can replay it (unseen values -> all zero).  A table of
    more than ``max_columns`` new columns is refused before a value is fetched:
    ``one_hot_vector`` encodes such a vocabulary."""
    cols = [c for c in (cols or ONE_HOT_COLS) if c in df.columns]
    if not cols:
        return df, vocab or []
    if vocab is None:
        v = one_hot_vocab(df, cols)
        rows = v.limit(max_columns + 1).collect()
        if len(rows) > max_columns:
            raise ValueError("more than max_columns values: use one_hot_vector")
        vocab = sorted((r["column"], r["value"]) for r in rows)
    new = {}
    for c, val in vocab:
        if c in cols:
            new[f"{c}_{val}"] = F.when(F.col(c) == F.lit(val), 1).otherwise(0).cast("bigint")
    return df.withColumns(new).drop(*cols), vocab


def one_hot_vector(df: DataFrame, cols: list[str] | None = None, model=None):
    """F11 for wide vocabularies: a sparse vector ``<col>_onehot`` per column in
    place of int columns (null and unseen -> all zero).  Returns the frame and
    the fitted pipeline model, which scoring passes back in."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    cols = [c for c in (cols or ONE_HOT_COLS) if c in df.columns]
    if model is None:
        index = StringIndexer(inputCols=cols, outputCols=[f"{c}_index" for c in cols], handleInvalid="keep", stringOrderType="alphabetAsc")
        # the invalid bucket is the last category, which the encoder drops
        code = OneHotEncoder(inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_onehot" for c in cols], dropLast=True)
        model = Pipeline(stages=[index, code]).fit(df)
    return model.transform(df).drop(*cols, *[f"{c}_index" for c in cols]), model


def hot_place(vector: str) -> Column:
    """Place of the 1 in a one-hot vector, null where it has none: the sparse
    vector's own indices, so its width costs nothing."""
    return F.get_json_object(F.to_json(F.struct(F.col(vector).alias("v"))), "$.v.indices[0]").cast("bigint")


def target_encode(df: DataFrame, col: str = "Country", target: str = "Churn",
                  out: str | None = None, fit_df: DataFrame | None = None) -> DataFrame:
    """Mean target per category joined back; the source is dropped.
    ``fit_df`` lets the means come from training rows only."""
    out = out or f"{col}_encoded"
    means = (fit_df if fit_df is not None else df).groupBy(col).agg(
        F.avg(F.col(target).cast("double")).alias(out))
    # one row per category: AQE broadcasts it from runtime size
    return df.join(means, col, "left").drop(col)


# --- F15-F21: reporting ------------------------------------------------------

def risk_band(p: Column | str) -> Column:
    """four-level risk band."""
    p = F.col(p) if isinstance(p, str) else p
    # Band names.
    return (F.when(p >= 0.75, F.lit("Critique")).when(p >= 0.5, F.lit("Élevé"))
             .when(p >= 0.25, F.lit("Modéré")).when(p.isNotNull(), F.lit("Faible")))


def risk_flag(p: Column | str) -> Column:
    """F16: two-level risk."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= 0.5, F.lit("Élevé")).when(p.isNotNull(), F.lit("Faible"))


def churn_label(pred: Column | str, long: bool = False) -> Column:
    """churn text label (short form of the library, long of the app)."""
    pred = F.col(pred) if isinstance(pred, str) else pred
    if long:
        return F.when(pred == 1, F.lit("Client Parti (Churned)")).otherwise(F.lit("Client Fidèle"))
    return F.when(pred == 1, F.lit("Parti")).otherwise(F.lit("Fidèle"))


# Recommended action per segment label.
SEGMENT_ACTIONS = {
    "VIP": "Fidélisation et programmes de récompenses premium.",
    "Fidele": "Campagnes de rétention et cross-selling.",
    "Occasionnel": "Stimuler la fréquence d'achat avec promotions.",
    "A Risque": "Actions de réactivation et analyse des causes de churn.",
}
DEFAULT_ACTION = "Actions marketing spécifiques à définir."

# Display name per segment label.
SEGMENT_DISPLAY = {
    "VIP": "Clients VIP / Fidèles",
    "Fidele": "Clients Fidèles",
    "Occasionnel": "Clients Occasionnels",
    "A Risque": "Clients à Risque",
}
DEFAULT_DISPLAY = "Inconnu"

# Churn level shown per segment label.
SEGMENT_CHURN_LEVEL = {
    "VIP": "Très faible",
    "Fidele": "Faible",
    "Occasionnel": "Modéré",
    "A Risque": "Élevé",
}
DEFAULT_CHURN_LEVEL = "-"


def _looked_up(label: Column | str, texts: dict[str, str], default: str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    lut = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(lut, label), F.lit(default))


def action_for(label: Column | str) -> Column:
    """recommended action per segment label."""
    return _looked_up(label, SEGMENT_ACTIONS, DEFAULT_ACTION)


def churn_level(label: Column | str) -> Column:
    """C11: churn level shown per segment label."""
    return _looked_up(label, SEGMENT_CHURN_LEVEL, DEFAULT_CHURN_LEVEL)


# Advice per predicted churn label.
CHURN_ADVICE = {
    1: ["Déclencher une campagne de rétention ciblée", "Offre de fidélisation personnalisée", "Contacter le service client sous 48h"],
    0: ["Maintenir l'engagement avec des offres exclusives", "Surveiller l'évolution de la satisfaction", "Programme de fidélité adapté au profil"],
}


def churn_advice(pred: Column | str) -> Column:
    """advice per churn label, an array of texts; null without a label."""
    pred = F.col(pred) if isinstance(pred, str) else pred
    say = {k: F.array(*[F.lit(t) for t in v]) for k, v in CHURN_ADVICE.items()}
    return F.when(pred == 1, say[1]).when(pred.isNotNull(), say[0])


def display_name(label: Column | str) -> Column:
    return _looked_up(label, SEGMENT_DISPLAY, DEFAULT_DISPLAY)


def verdict_r2(r2: Column) -> Column:
    """regression quality verdict."""
    return (F.when(r2 >= 0.7, F.lit("Bon")).when(r2 >= 0.5, F.lit("Acceptable"))
             .otherwise(F.lit("Faible")))


def verdict_auc(auc: Column) -> Column:
    """leak alarm when AUC > 0.98."""
    return F.when(auc > 0.98, F.lit("Fuite possible")).otherwise(F.lit("OK"))


def verdict_cv_std(std: Column) -> Column:
    """fold stability when std < 0.03."""
    return F.when(std < 0.03, F.lit("Stable")).otherwise(F.lit("Instable"))


def verdict_segment(label: Column, churn: Column) -> Column:
    """segment check; loyal segments must churn below 40 %."""
    return (F.when(label.isin("VIP", "Fidele") & (churn < 0.4), F.lit("[OK]"))
             .when(label.isin("Occasionnel", "A Risque"), F.lit("[OK]"))
             .otherwise(F.lit("[!]")))


def fmt_fixed(x: Column, d: int) -> Column:
    """Round half-even first, then print: identical text in every engine."""
    return F.format_string(f"%.{d}f", round_even(x, d))


def minmax_profile(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min + 1e-9) across the rows of a grouped summary.
    The input is a per-group summary (bounded by the number of groups)."""
    w = Window.partitionBy()
    return df.select(key, *[((F.col(c) - F.min(c).over(w)) /
                             (F.max(c).over(w) - F.min(c).over(w) + F.lit(1e-9))).alias(c)
                            for c in cols])

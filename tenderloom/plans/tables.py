"""Stand-in procurement tables over the TPC-H-like test data.

A deployment reads its own `opportunities`, `contracts`, `runs` and text tables.
The test data holds none of those, so these views derive them from orders, line
items, events, documents and pages. Each view is one list of column expressions
used by both Spark and the SQL twin; they are input data, not operators.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-09-02"
AS_OF_TS = "1998-09-02 00:00:00"
EVENTS_AS_OF = "2024-01-31"


class SparkDialect:
    @staticmethod
    def arr(*items: str) -> str:
        return f"array({', '.join(items)})" if items else "cast(array() AS array<string>)"

    @staticmethod
    def doc(name: str, url: str, kind: str) -> str:
        return f"named_struct('name', {name}, 'url', {url}, 'kind', {kind})"

    @staticmethod
    def hours(n: str) -> str:
        return f"make_dt_interval(0, CAST({n} AS INT))"

    no_docs = "cast(array() AS array<struct<name:string,url:string,kind:string>>)"


class DuckDialect:
    @staticmethod
    def arr(*items: str) -> str:
        return f"[{', '.join(items)}]" if items else "CAST([] AS VARCHAR[])"

    @staticmethod
    def doc(name: str, url: str, kind: str) -> str:
        return f"struct_pack(name := {name}, url := {url}, kind := {kind})"

    @staticmethod
    def hours(n: str) -> str:
        return f"to_hours(CAST({n} AS BIGINT))"

    no_docs = "CAST([] AS STRUCT(name VARCHAR, url VARCHAR, kind VARCHAR)[])"


def bid_columns(d) -> dict[str, str]:
    k = "o_orderkey"
    amt = "CAST(floor(o_totalprice) AS BIGINT)"
    base = f"'https://portal.example.gov/bids/' || CAST({k} AS STRING)"
    spec = d.doc("'Specification ' || p_brand", base + " || '/spec.PDF?v=2'", "'specification'")
    addendum = d.doc("'Addendum 1'", base + " || '/addendum1.pdf'", "'addendum'")
    package = d.doc("'Bid package'", base + " || '/package.pdf'", "'document'")
    named = d.doc(f"'RFQ-' || CAST(o_custkey AS STRING) || '-0' || CAST({k} % 3 AS STRING)",
                  base + " || '/named.pdf'", "'document'")
    drawing = d.doc("'Drawing A'", base + " || '/a.dwg'", "'drawing'")
    return {
        "ordinal": k,
        "opportunity_id": f"CAST({k} AS STRING)",
        "source_id": "o_orderpriority",
        "source_name": "'Portal ' || o_orderpriority",
        "external_id": f"""CASE WHEN {k} % 7 = 3 THEN NULL
            WHEN {k} % 29 = 0 THEN 'A-' || CAST({k} % 10 AS STRING)
            WHEN {k} % 2 = 0 THEN 'RFQ-' || CAST(o_custkey AS STRING) || '-0' || CAST({k} % 3 AS STRING)
            ELSE 'rfq ' || CAST(o_custkey AS STRING) || ' 0' || CAST({k} % 3 AS STRING) END""",
        "title": f"""p_name || CASE WHEN {k} % 5 = 0 THEN '' ELSE ' ' || lower(c_mktsegment) END
            || CASE WHEN {k} % 3 = 0 THEN ' ' || lower(p_type) ELSE '' END || ' Services'
            || CASE WHEN {k} % 2 = 0 THEN ' ' || CAST(year(o_orderdate) AS STRING) ELSE '' END""",
        "url": base,
        "county": """CASE r_name WHEN 'AFRICA' THEN 'broward' WHEN 'AMERICA' THEN 'miami-dade'
            WHEN 'ASIA' THEN 'palm-beach' WHEN 'EUROPE' THEN 'statewide' ELSE 'orange' END""",
        "agency": "n_name",
        "department": f"""CASE {k} % 12 WHEN 0 THEN 'Miami-Dade Public Works'
            WHEN 5 THEN 'Broward County Office' WHEN 7 THEN '' ELSE NULL END""",
        "tier": f"CASE {k} % 4 WHEN 0 THEN 'county' WHEN 1 THEN 'municipal' WHEN 2 THEN 'unknown' ELSE NULL END",
        "solicitation_type": f"CASE {k} % 3 WHEN 0 THEN 'RFP' WHEN 1 THEN 'ITB' ELSE 'UNKNOWN' END",
        "offer_type": """CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'AUTOMOBILE' THEN 'goods'
            WHEN 'MACHINERY' THEN 'services' WHEN 'FURNITURE' THEN 'professional_services' ELSE 'unknown' END""",
        "categories": f"""CASE WHEN {k} % 17 = 0 THEN {d.arr()} WHEN {k} % 19 = 0 THEN {d.arr("'general'")}
            WHEN {k} % 23 = 0 THEN {d.arr("lower(c_mktsegment)", "lower(p_type)", "'general'")}
            ELSE {d.arr("lower(c_mktsegment)", "lower(p_type)")} END""",
        "keywords": f"""CASE {k} % 14 WHEN 0 THEN {d.arr("'broward'", "'palm-beach'")}
            WHEN 1 THEN {d.arr("'orange'", "'paving'")} ELSE {d.arr()} END""",
        "raw_category": f"CASE {k} % 4 WHEN 0 THEN p_brand WHEN 1 THEN '' ELSE NULL END",
        "commodity_codes": f"""CASE WHEN {k} % 3 = 0 THEN {d.arr("'NIGP ' || CAST(10000 + p_size AS STRING)")}
            ELSE {d.arr()} END""",
        "posted_date": f"CASE WHEN {k} % 6 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) - 45 END",
        "due_date": f"CASE WHEN {k} % 9 = 0 THEN NULL ELSE o_orderdate + {d.hours(f'{k} % 24')} END",
        "status": f"""CASE WHEN {k} % 11 = 0 THEN 'catalog' WHEN {k} % 13 = 0 THEN 'cancelled'
            WHEN {k} % 17 = 5 THEN 'closed' WHEN o_orderstatus = 'O' THEN 'open'
            WHEN o_orderstatus = 'P' THEN 'upcoming' ELSE 'award' END""",
        "description": f"""CASE {k} % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
            ELSE 'Furnish ' || p_name || ' for ' || n_name || '; see package.' END""",
        "contact": f"CASE {k} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END",
        "contact_email": f"CASE WHEN {k} % 5 = 0 THEN 'buyer' || CAST({k} % 50 AS STRING) || '@example.gov' END",
        "contact_phone": f"CASE WHEN {k} % 6 = 0 THEN '(305) 555-0100' END",
        "budget": f"""CASE {k} % 10 WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN '$1,200.50'
            WHEN 6 THEN '$' || CAST({amt} AS STRING) || ' - $' || CAST({amt} * 2 AS STRING)
            WHEN 7 THEN 'TBD' ELSE '$' || CAST({amt} AS STRING) END""",
        "scope": f"""CASE WHEN {k} % 4 = 2 THEN NULL
            ELSE 'Scope: ' || p_name || ' ' || p_brand || ' work at ' || n_name || '.' END""",
        "requirements": f"""(CASE WHEN {k} % 2 = 0 THEN {d.arr("'Bid bond'")} ELSE {d.arr()} END)
            || (CASE WHEN {k} % 3 = 0 THEN {d.arr("'Insurance certificate'")} ELSE {d.arr()} END)
            || (CASE WHEN {k} % 5 = 0 THEN {d.arr("'SBE/MBE/DBE participation'")} ELSE {d.arr()} END)
            || (CASE WHEN {k} % 7 = 0 THEN {d.arr("'Living wage'")} ELSE {d.arr()} END)""",
        "documents": f"""CASE {k} % 4 WHEN 0 THEN {d.no_docs} WHEN 1 THEN {d.arr(spec)}
            WHEN 2 THEN {d.arr(addendum, package, named)} ELSE {d.arr(drawing, addendum)} END""",
        "submittal_info": f"CASE {k} % 8 WHEN 0 THEN 'Deliver to the clerk' WHEN 1 THEN '' END",
        "pre_bid_meeting": f"CASE WHEN {k} % 9 = 1 THEN 'Pre-bid meeting on site' END",
        "project_location": f"CASE WHEN {k} % 10 = 0 THEN n_name || ' depot' END",
        "duration_days": f"CASE WHEN {k} % 3 = 1 THEN CAST(30 + {k} % 300 AS INT) WHEN {k} % 3 = 2 THEN 0 END",
        "liquidated_damages": f"CASE WHEN {k} % 6 = 2 THEN '$500 per day' END",
        "licenses": f"CASE WHEN {k} % 11 = 1 THEN 'Class A' END",
        "awarded_vendor": f"""CASE WHEN o_orderstatus = 'F' AND {k} % 5 <> 0
            THEN 'Supplier#' || lpad(CAST({k} % 100 AS STRING), 9, '0')
              || CASE {k} % 3 WHEN 0 THEN ' LLC' WHEN 1 THEN ', Inc.' ELSE '' END END""",
        "award_amount": f"""CASE WHEN o_orderstatus = 'F' AND {k} % 40 = 1 THEN CAST(0 AS BIGINT)
            WHEN o_orderstatus = 'F' AND {k} % 8 <> 0 THEN {amt} END""",
        "award_date": f"CASE WHEN o_orderstatus = 'F' AND {k} % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 10 END",
        "linked_ref": f"""CASE WHEN o_orderstatus = 'F' AND {k} % 4 = 1
            THEN 'RFQ ' || CAST(o_custkey AS STRING) || ' 0' || CAST(({k} + 1) % 3 AS STRING) END""",
        "prior_cycles": f"CASE WHEN {k} % 5 = 0 THEN 2 ELSE 0 END",
        "first_seen_at": "o_orderdate",
        "personalized": f"({k} % 50 = 0)",
    }


def contract_columns(d) -> dict[str, str]:
    return {
        "order_key": "l_orderkey",
        "line": "l_linenumber",
        "part_key": "l_partkey",
        "supplier_key": "l_suppkey",
        "source_id": "'register-' || lower(l_returnflag)",
        "contract_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
        "agency": "n_name",
        "name": "p_name || ' ' || lower(p_type)",
        "category": "lower(p_type)",
        "vendor": """CASE WHEN l_quantity = 1 THEN NULL WHEN l_linenumber % 3 = 0 THEN s_name || ' LLC'
            WHEN l_linenumber % 3 = 1 THEN upper(s_name) || ', INC.' ELSE s_name END""",
        "amount": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END",
        "start_date": "CAST(l_shipdate AS DATE) - 365",
        "end_date": "CASE WHEN l_quantity = 2 THEN NULL ELSE CAST(l_shipdate AS DATE) END",
        "method": "l_returnflag",
        "extendable": "(l_linestatus = 'O')",
        "commodity": "p_type",
    }


def doc_columns(d) -> dict[str, str]:
    """Documents as solicitations; the invented prose gets one known phrase per row."""
    return {
        "doc_id": "doc_id",
        "ordinal": "doc_id",
        "agency": "source",
        "county": "lang",
        "lead": f"""CASE doc_id % 12
            WHEN 0 THEN 'A bid bond and a performance bond are required; not to exceed $1,250,000.'
            WHEN 1 THEN 'RFP No. 2024-118 request for proposals. Estimated cost is $2.5 million.'
            WHEN 2 THEN 'Mandatory site visit. A mandatory meeting and pre-bid conference at Hall B, room 4. Call (305) 555-0142.'
            WHEN 3 THEN 'Licensed vendors with liability insurance; budget of $ 48,000 per year. ITB20231188.'
            WHEN 4 THEN 'Questions due March 14, 2024 by 3:30 PM. E-mail bids@city.example.gov.'
            WHEN 5 THEN 'E-Verify and drug-free workplace apply. A $50 fee and $75,000 deposit, $310,500 total.'
            WHEN 6 THEN 'Invitation to bid EVN0012345, prevailing wage, local preference, SBE goal.'
            WHEN 7 THEN 'Prequalification and three references; background check; public entity crimes form.'
            WHEN 8 THEN 'Project amount of $950K, bonding capacity letter. Inquiries by 4/2/2024.'
            WHEN 9 THEN 'Roof replacement and asphalt paving at the water plant, janitorial services and software.'
            WHEN 10 THEN 'Request for qualifications: architect, HVAC repair, security guard, office furniture.'
            ELSE 'No terms stated.' END""",
        "scope": "text",
        "lang": "lang",
        "source": "source",
        "n_chars": "n_chars",
    }


# Pages as fetched, each ending in one of ten known procurement snippets.
PAGE_SNIPPETS = [
    '<p><a href="https://acme.bonfirehub.com/portal/?tab=open">Bid Opportunities</a></p>',
    '<a class="x" href="/Bids.aspx">Current Bids</a> <a href="/vendors">Vendor list</a><link href="/Common/Modules/Bids/RWDBids.css"> DemandStar',
    'RFP#2026-01 due 01/15/2026 and ITB 26-014 due March 3, 2026',
    '<a href="docs/n.pdf">Public Notice - RFP No. 2026-023 Roof Revised [PDF]</a><a href="/docs/b.pdf">RFP No. 2026-023 Roof repairs at City Hall</a>'
    '<a href="x.pdf">Award ITB 2026-001 results</a>',
    '<a href="/DocumentCenter/View/1">Addendum 1</a><a href="spec.docx">Specifications</a><a href="/DocumentCenter/View/1">Addendum again</a>'
    '<a href="p/plan.pdf">Site plan</a>',
    '<p>Awarded To: Crown USA, Inc.; term</p>',
    '<a href="https://procurement.opengov.com/portal/embed/davie/project-list">procurement</a> periscope holdings',
    '<table><tr><th>Bid/Solicitation</th><th>Posted</th></tr><tr><td>RFP 1 Paving</td><td>1/2/2026</td></tr><tr><td>ITB 2 Roof</td><td>2/3/2026</td></tr></table>',
    '<div><label>Status:</label><span>Open</span><b>Closing Date:</b> 3/4/2026</div>',
    '&lt;b&gt;Fees &amp;amp; taxes&lt;br/&gt;apply&lt;/b&gt;',
]


def page_columns(d) -> dict[str, str]:
    cases = " ".join(f"WHEN {i} THEN '{snippet}'" for i, snippet in enumerate(PAGE_SNIPPETS))
    return {"page_id": "page_id", "url": "url", "html": f"html || CASE page_id % 10 {cases} END"}


FROM_BIDS = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = o_custkey"""
FROM_CONTRACTS = """lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey"""

# One run per calendar day; a source's count is the views and purchases it saw that day.
RUNS_SQL = """SELECT 'src' || CAST(user_id AS STRING) AS source_id, CAST(ts AS DATE) AS run_day,
    CAST(sum(CASE WHEN event_type IN ('view', 'purchase') THEN 6 ELSE 0 END) AS BIGINT) AS row_count,
    CAST(count(*) AS BIGINT) AS events,
    CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INT) AS had_error
    FROM events GROUP BY user_id, CAST(ts AS DATE)"""

LOG_SQL = """SELECT event_id, ts, 'ent' || CAST(user_id AS STRING) AS entity_id,
    CASE event_type WHEN 'click' THEN 'opengov' WHEN 'view' THEN 'bonfire' WHEN 'purchase' THEN 'ionwave'
      WHEN 'signup' THEN 'selfhosted' ELSE 'unknown' END AS platform, event_type, value, props
    FROM events"""

# One message per turn of a conversation; `n` varies what it says.
MESSAGES_SQL = """SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id, conv_id * 31 + turn AS n, text AS opening FROM conversations"""


def _select(columns: dict[str, str], source: str) -> str:
    listed = ",\n    ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT {listed}\nFROM {source}"


def view_sql(name: str, dialect) -> str:
    if name == "bids":
        return _select(bid_columns(dialect), FROM_BIDS)
    if name == "contracts":
        return _select(contract_columns(dialect), FROM_CONTRACTS)
    if name == "pg":
        return _select(page_columns(dialect), "pages")
    if name == "docs":
        return _select(doc_columns(dialect), "documents")
    return {"runs": RUNS_SQL, "log": LOG_SQL, "messages": MESSAGES_SQL}[name]


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix `sql` with the stand-in views it names, as common table expressions."""
    body = sql.strip()
    if not views:
        return body
    ctes = ",\n".join(f"{v} AS ({view_sql(v, DuckDialect)})" for v in views)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "labels", "pages", "conversations")


FACT_TABLES = ("orders", "lineitem", "events", "documents", "pages", "conversations")


VIEW_BASES = {
    "bids": ("orders", "customer", "nation", "region", "part"),
    "contracts": ("lineitem", "supplier", "nation", "part"),
    "docs": ("documents",),
    "pg": ("pages",),
    "runs": ("events",),
    "log": ("events",),
    "messages": ("conversations",),
}


SPREAD_KEY = "spark.tenderloom.spread"


class Tables:
    """Lazy DataFrames over one scale-factor folder.

    The test tables are single files of one row group, which one task reads
    alone. A session may set `spark.tenderloom.spread` to a number of partitions to
    deal the fact tables to; unset, as on a cluster, they stay as they are read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        spread = self.spark.conf.get(SPREAD_KEY, None)
        return df.repartition(int(spread)) if spread and name in FACT_TABLES else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    def view(self, name: str, **given: DataFrame) -> DataFrame:
        """The stand-in view `name`, over the tables `given` in place of its own."""
        bases = VIEW_BASES[name]
        sql = view_sql(name, SparkDialect)
        return self.spark.sql(
            sql_with_braces(sql, bases), **({b: self.base(b) for b in bases if b not in given} | given))

    @cached_property
    def bids(self) -> DataFrame:
        return self.view("bids")

    @cached_property
    def contracts(self) -> DataFrame:
        return self.view("contracts")

    @cached_property
    def docs(self) -> DataFrame:
        return self.view("docs")

    @cached_property
    def pg(self) -> DataFrame:
        return self.view("pg")

    @cached_property
    def runs(self) -> DataFrame:
        return self.view("runs")

    @cached_property
    def log(self) -> DataFrame:
        return self.view("log")

    @cached_property
    def messages(self) -> DataFrame:
        return self.view("messages")


def sql_with_braces(sql: str, bases: tuple[str, ...]) -> str:
    """Turn the FROM clause's table names into `{name}` DataFrame references."""
    head, tail = sql.rsplit("FROM ", 1)
    words = []
    for word in tail.split(" "):
        bare = word.strip("\n")
        words.append(word.replace(bare, "{" + bare + "}") if bare in bases else word)
    return head + "FROM " + " ".join(words)

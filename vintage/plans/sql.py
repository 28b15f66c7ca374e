"""Pieces of the oracle statements: common table expressions by name."""

from __future__ import annotations

import re

from vintage.sources.fixture import CTES

YEARS = tuple(range(1995, 2002))
BASE = 1998

#: name -> expression over the fixture; later ones may use earlier ones.
PARTS: dict[str, str] = {
    "degs": """SELECT *, count(*) OVER (PARTITION BY period, vintage_a_code) AS deg_a, count(*) OVER (PARTITION BY period, vintage_b_code) AS deg_b FROM edges""",
    "links": """SELECT period, 'A'||vintage_a_code AS u, 'B'||vintage_b_code AS v FROM edges UNION SELECT period, 'B'||vintage_b_code, 'A'||vintage_a_code FROM edges""",
    "reach(period, node, root)": """SELECT period, u, u FROM links UNION SELECT r.period, l.v, r.root FROM reach r JOIN links l ON r.period=l.period AND r.node=l.u""",
    "comp": """SELECT period, node, min(root) AS comp FROM reach GROUP BY 1,2""",
    "tagged": """SELECT e.*, c.comp FROM edges e JOIN comp c ON e.period=c.period AND c.node='A'||e.vintage_a_code""",
    "gids": """SELECT period, comp, period||'_g'||lpad(CAST(row_number() OVER (PARTITION BY period ORDER BY min(vintage_a_code), min(vintage_b_code)) AS STRING),6,'0') AS group_id FROM tagged GROUP BY 1,2""",
    "ge": """SELECT t.period, vintage_a_year, vintage_b_year, vintage_a_code, vintage_b_code, group_id FROM tagged t JOIN gids g ON t.period=g.period AND t.comp=g.comp""",
    "summ": """SELECT g.period, vintage_a_year, vintage_b_year, g.group_id, count(DISTINCT g.vintage_a_code) AS n_vintage_a, count(DISTINCT g.vintage_b_code) AS n_vintage_b, count(*) AS n_edges,
        max(deg_a)>1 AS a_to_b_ambiguous, max(deg_b)>1 AS b_to_a_ambiguous FROM ge g JOIN degs d USING (period, vintage_a_code, vintage_b_code, vintage_a_year, vintage_b_year) GROUP BY 1,2,3,4""",
    "ori": """SELECT period, 'a_to_b' AS direction, vintage_a_year AS from_vintage_year, vintage_b_year AS to_vintage_year, vintage_a_code AS from_code, vintage_b_code AS to_code, group_id FROM ge
        UNION ALL SELECT period, 'b_to_a', vintage_b_year, vintage_a_year, vintage_b_code, vintage_a_code, group_id FROM ge""",
    "amb": """SELECT period, 'a_to_b' AS direction, group_id FROM summ WHERE a_to_b_ambiguous UNION ALL SELECT period, 'b_to_a', group_id FROM summ WHERE b_to_a_ambiguous""",
    "rev": """SELECT period, direction, from_code AS code FROM ori GROUP BY 1,2,3 HAVING count(DISTINCT to_code)>1 UNION SELECT o.period, o.direction, o.from_code FROM ori o JOIN amb USING (period, direction, group_id)""",
    "univ": """SELECT DISTINCT PERIOD AS year, PRODUCT_NC AS code FROM trade""",
    "uni": """SELECT period, 'a_to_b' AS direction, vintage_a_code AS from_code, vintage_b_code AS to_code, 1.0/count(*) OVER (PARTITION BY period, vintage_a_code) AS weight FROM edges
        UNION ALL SELECT period, 'b_to_a', vintage_b_code, vintage_a_code, 1.0/count(*) OVER (PARTITION BY period, vintage_b_code) FROM edges""",
    "cg": """SELECT DISTINCT period, 'a' AS side, vintage_a_year AS year, vintage_a_code AS code, group_id FROM ge UNION SELECT DISTINCT period, 'b', vintage_b_year, vintage_b_code, group_id FROM ge""",
    "uniq": """SELECT period, direction, from_code, to_code, CASE WHEN to_code=min(to_code) OVER w THEN 2.0 ELSE 1.0 END/(count(*) OVER w + 1) AS weight FROM uni WINDOW w AS (PARTITION BY period, direction, from_code)""",
    "lng": """SELECT REPORTER, PARTNER, PRODUCT_NC AS code, CAST(PERIOD AS STRING) AS year, 'VALUE_EUR' AS measure, VALUE_EUR AS val FROM trade WHERE FLOW='1'
        UNION ALL SELECT REPORTER, PARTNER, PRODUCT_NC, CAST(PERIOD AS STRING), 'QUANTITY_KG', QUANTITY_KG FROM trade WHERE FLOW='1'""",
    "sh0": """SELECT c.period, a.direction, l.measure, c.group_id, c.side, c.code, l.REPORTER, l.PARTNER, sum(l.val) AS value
        FROM lng l JOIN cg c ON l.year=c.year AND l.code=c.code JOIN amb a ON a.period=c.period AND a.group_id=c.group_id GROUP BY ALL""",
    "sh": """SELECT *, sum(value) OVER (PARTITION BY period, direction, measure, group_id, side) AS total, value/sum(value) OVER (PARTITION BY period, direction, measure, group_id, side) AS share FROM sh0""",
    "tot0": """SELECT period, direction, measure, group_id, sum(CASE WHEN side='a' THEN value END) AS ta, sum(CASE WHEN side='b' THEN value END) AS tb,
        count(CASE WHEN side='a' THEN 1 END) AS ra, count(CASE WHEN side='b' THEN 1 END) AS rb,
        count(DISTINCT CASE WHEN side='a' THEN REPORTER||PARTNER END) AS pa, count(DISTINCT CASE WHEN side='b' THEN REPORTER||PARTNER END) AS pb FROM sh GROUP BY 1,2,3,4""",
    "tots": """SELECT a.period, a.direction, m.measure, a.group_id, coalesce(ta,0) AS total_a, coalesce(tb,0) AS total_b, coalesce(ra,0) AS n_rows_a, coalesce(rb,0) AS n_rows_b, coalesce(pa,0) AS n_pairs_a, coalesce(pb,0) AS n_pairs_b,
        CASE WHEN coalesce(ta,0)<=0 AND coalesce(tb,0)<=0 THEN 'zero_total_a_b' WHEN coalesce(ta,0)<=0 THEN 'zero_total_a' WHEN coalesce(tb,0)<=0 THEN 'zero_total_b' END AS skip_reason
        FROM amb a CROSS JOIN (SELECT 'VALUE_EUR' AS measure UNION ALL SELECT 'QUANTITY_KG') m LEFT JOIN tot0 t ON t.period=a.period AND t.direction=a.direction AND t.group_id=a.group_id AND t.measure=m.measure""",
    "used": """SELECT s.*, ((s.side='a') = (s.direction='a_to_b')) AS is_from FROM sh s JOIN tots t USING (period, direction, measure, group_id) WHERE t.skip_reason IS NULL""",
    "mom": """SELECT x.period, x.direction, x.measure, x.group_id, 'm' AS kind, x.code AS i, y.code AS j, sum(x.share*y.share) AS value FROM used x JOIN used y USING (period, direction, measure, group_id, REPORTER, PARTNER) WHERE x.is_from AND y.is_from GROUP BY ALL
        UNION ALL SELECT x.period, x.direction, x.measure, x.group_id, 'n', x.code, y.code, sum(x.share*y.share) FROM used x JOIN used y USING (period, direction, measure, group_id, REPORTER, PARTNER) WHERE x.is_from AND NOT y.is_from GROUP BY ALL""",
    "ptot": """SELECT PERIOD AS year, PRODUCT_NC AS code, sum(VALUE_EUR) AS value FROM trade WHERE FLOW='1' GROUP BY 1,2""",
}


def chain_parts(target: int, tag: str = "", uni: str = "uni", years: tuple[int, ...] = YEARS) -> dict[str, str]:
    """c<tag><origin>: chained weights of each origin to the target, right fold;
    chain<tag>: all of them."""
    out = {f"c{tag}{target}": f"SELECT code AS from_code, code AS to_code, 1.0 AS weight FROM univ WHERE year={target}"}
    for sign, walk in ((1, range(target - 1, years[0] - 1, -1)), (-1, range(target + 1, years[-1] + 1))):
        later = None
        for y in walk:
            period, direction = step_of(y, sign)
            step = f"SELECT from_code, to_code, weight FROM {uni} WHERE period='{period}' AND direction='{direction}'"
            out[f"s{tag}{y}"] = f"{step} UNION ALL SELECT code, code, 1.0 FROM univ WHERE year={y} AND code NOT IN (SELECT from_code FROM {uni} WHERE period='{period}' AND direction='{direction}')"
            out[f"c{tag}{y}"] = f"SELECT * FROM s{tag}{y}" if later is None else (
                f"SELECT s.from_code, coalesce(c.to_code, s.to_code) AS to_code, sum(s.weight*coalesce(c.weight,1.0)) AS weight FROM s{tag}{y} s LEFT JOIN c{tag}{later} c ON s.to_code=c.from_code GROUP BY 1,2"
            )
            later = y
    out[f"chain{tag}"] = " UNION ALL ".join(f"SELECT {y} AS origin_year, from_code, to_code, weight FROM c{tag}{y}" for y in years)
    return out


def step_of(year: int, sign: int) -> tuple[str, str]:
    return (f"{year}{year + 1}", "a_to_b") if sign > 0 else (f"{year - 1}{year}", "b_to_a")


def panel_parts(target: int, tag: str = "") -> dict[str, str]:
    """Sample, totals, shares and pairs of neighbouring years at the target."""
    return {
        f"btot{tag}": f"""SELECT p.year, coalesce(c.to_code, p.code) AS code, sum(p.value*coalesce(c.weight,1.0)) AS value FROM ptot p LEFT JOIN chain{tag} c ON c.origin_year=p.year AND c.from_code=p.code GROUP BY 1,2""",
        f"smp{tag}": f"""SELECT DISTINCT s.vintage_b_code AS code, s.group_id FROM ge s JOIN summ m USING (period, group_id) WHERE s.period='{target - 1}{target}' AND m.a_to_b_ambiguous""",
        f"bsh0{tag}": f"""SELECT b.year, s.group_id, s.code, coalesce(b.value,0) AS value FROM smp{tag} s JOIN btot{tag} b ON b.code=s.code""",
        f"bsh{tag}": f"""SELECT *, value/sum(value) OVER (PARTITION BY year, group_id) AS share FROM bsh0{tag}""",
        f"pairs{tag}": pairs_of(f"bsh{tag}"),
    }


def pairs_of(shares: str) -> str:
    return f"""SELECT x.year AS x_year, y.year AS y_year, x.group_id, x.code, x.share AS share_t, y.share AS share_t1, x.value AS value_x, y.value AS value_y FROM {shares} x JOIN {shares} y ON x.group_id=y.group_id AND x.code=y.code AND y.year=x.year+1"""


PARTS |= chain_parts(BASE) | chain_parts(BASE, "q", "uniq") | panel_parts(BASE)


def statement(body: str) -> str:
    """A statement with the fixture and the parts that it uses in scope."""
    names = {name.split("(")[0]: name for name in PARTS}
    used: dict[str, None] = {}  # in order of need

    def need(text: str, within: str = "") -> None:
        for n in re.findall(r"\w+", text):
            if n in names and n != within and n not in used:
                need(PARTS[names[n]], n)
                used[n] = None

    need(body)
    parts = [f"{names[n]} AS ({PARTS[names[n]]})" for n in used]
    return "WITH RECURSIVE " + ",\n".join([CTES.strip(), *parts]) + "\n" + body

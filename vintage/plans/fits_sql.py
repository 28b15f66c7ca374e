"""Oracle parts for the fits: closed forms for the shapes that the fixture has.

One code with several links: what fixed codes explain is taken off, and the rest
projected on the simplex. Two codes with two common targets, B = [[p, 1-p], [q, 1-q]]:
the least of a p^2 + 2 b p q + d q^2 - e p - f q over the unit square, by trying the
inside and the four edges; where a d = b^2 only sqrt(a) p + sqrt(d) q is told, and the
point of that line nearest to the middle of the square is taken.
"""

from __future__ import annotations

KEY = "period, direction, measure, bin, group_id"
LINKS = {
    "flt": "SELECT *, count(*) OVER (PARTITION BY period, direction, from_code) AS n_to FROM ori",
    "fgr": """SELECT period, direction, group_id, count(DISTINCT CASE WHEN n_to>1 THEN from_code END) AS n_free, count(*) AS n_links, min(from_code) AS f1, max(from_code) AS f2, min(to_code) AS t1, max(to_code) AS t2,
        count(DISTINCT from_code) AS nf, count(DISTINCT to_code) AS nt FROM flt GROUP BY 1,2,3""",
}


def fit_parts(tag: str, moments: str) -> dict[str, str]:
    """fit<tag>: KEY, from_code, to_code, weight of the fits of ``moments`` (KEY, kind, i, j, value)."""
    t = tag
    return {
        f"fk{t}": f"SELECT DISTINCT {KEY} FROM {moments}",
        f"fr{t}": f"SELECT {KEY}, from_code, to_code FROM fk{t} JOIN flt USING (period, direction, group_id) JOIN fgr USING (period, direction, group_id) WHERE n_free=1 AND n_to>1",
        f"fo{t}": f"SELECT {KEY}, m.i AS from_code, o.to_code, sum(m.value) AS v FROM {moments} m JOIN flt o USING (period, direction, group_id) WHERE m.kind='m' AND m.i<>m.j AND o.from_code=m.j AND o.n_to=1 GROUP BY ALL",
        f"fz{t}": f"""SELECT {", ".join("r." + k for k in KEY.split(", "))}, r.from_code, r.to_code, (coalesce(n.value,0)-coalesce(o.v,0))/m.value AS z FROM fr{t} r
            LEFT JOIN {moments} m ON m.kind='m' AND m.i=r.from_code AND m.j=r.from_code AND m.period=r.period AND m.direction=r.direction AND m.measure=r.measure AND m.bin=r.bin AND m.group_id=r.group_id
            LEFT JOIN {moments} n ON n.kind='n' AND n.i=r.from_code AND n.j=r.to_code AND n.period=r.period AND n.direction=r.direction AND n.measure=r.measure AND n.bin=r.bin AND n.group_id=r.group_id
            LEFT JOIN fo{t} o ON o.from_code=r.from_code AND o.to_code=r.to_code AND o.period=r.period AND o.direction=r.direction AND o.measure=r.measure AND o.bin=r.bin AND o.group_id=r.group_id""",
        f"fc{t}": f"SELECT *, row_number() OVER w AS k, sum(z) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS css, count(*) OVER (PARTITION BY {KEY}, from_code) AS n FROM fz{t} WINDOW w AS (PARTITION BY {KEY}, from_code ORDER BY z DESC, to_code)",
        f"ft{t}": f"SELECT *, max(CASE WHEN z*k>css THEN k END) OVER (PARTITION BY {KEY}, from_code) AS kmax FROM fc{t}",
        f"f1{t}": f"SELECT {KEY}, from_code, to_code, CASE WHEN z IS NULL THEN 1.0/n ELSE greatest(z - max(CASE WHEN k=kmax THEN css/k END) OVER (PARTITION BY {KEY}, from_code), 0.0) END AS weight FROM ft{t}",
        f"qt{t}": f"""SELECT {KEY}, f1, f2, t1, t2,
            coalesce(sum(CASE WHEN kind='m' AND i=f1 AND j=f1 THEN value END),0) AS a, coalesce(sum(CASE WHEN kind='m' AND i=f1 AND j=f2 THEN value END),0) AS b, coalesce(sum(CASE WHEN kind='m' AND i=f2 AND j=f2 THEN value END),0) AS d,
            coalesce(sum(CASE WHEN kind='n' AND i=f1 AND j=t1 THEN value WHEN kind='n' AND i=f1 AND j=t2 THEN -value END),0) AS n1, coalesce(sum(CASE WHEN kind='n' AND i=f2 AND j=t1 THEN value WHEN kind='n' AND i=f2 AND j=t2 THEN -value END),0) AS n2
            FROM {moments} JOIN fgr USING (period, direction, group_id) WHERE n_free=2 AND nf=2 AND nt=2 AND n_links=4 GROUP BY ALL""",
        f"qe{t}": f"SELECT *, a+b+n1 AS e, b+d+n2 AS f, a*d-b*b > 1e-10*a*d AS told FROM qt{t}",
        f"qp{t}": f"""SELECT *, (d*e-b*f)/(2*(a*d-b*b)) AS p, (a*f-b*e)/(2*(a*d-b*b)) AS q FROM qe{t} WHERE told
            UNION ALL SELECT *, 0, greatest(0, least(1, f/(2*d))) FROM qe{t} WHERE told UNION ALL SELECT *, 1, greatest(0, least(1, (f-2*b)/(2*d))) FROM qe{t} WHERE told
            UNION ALL SELECT *, greatest(0, least(1, e/(2*a))), 0 FROM qe{t} WHERE told UNION ALL SELECT *, greatest(0, least(1, (e-2*b)/(2*a))), 1 FROM qe{t} WHERE told""",
        f"qb{t}": f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY a*p*p+2*b*p*q+d*q*q-p*e-q*f) AS best FROM qp{t} WHERE p BETWEEN 0 AND 1 AND q BETWEEN 0 AND 1",
        f"ql{t}": f"SELECT *, sqrt(a) AS sa, sqrt(d) AS sd, e/(2*sqrt(a)) AS c FROM qe{t} WHERE NOT told AND a>0 AND d>0",
        f"qm{t}": f"SELECT *, 0.5+sa*(c-(sa+sd)/2)/(a+d) AS p0, 0.5+sd*(c-(sa+sd)/2)/(a+d) AS q0 FROM ql{t}",
        f"qn{t}": f"SELECT *, greatest(greatest(-p0/sd, (q0-1)/sa), least(least((1-p0)/sd, q0/sa), 0)) AS along FROM qm{t}",
        f"qq{t}": f"""SELECT {KEY}, f1, f2, t1, t2, p, q FROM qb{t} WHERE best=1
            UNION ALL SELECT {KEY}, f1, f2, t1, t2, CASE WHEN c<=0 THEN 0 WHEN c>=sa+sd THEN 1 ELSE p0+sd*along END, CASE WHEN c<=0 THEN 0 WHEN c>=sa+sd THEN 1 ELSE q0-sa*along END FROM qn{t}
            UNION ALL SELECT {KEY}, f1, f2, t1, t2, CASE WHEN a>0 THEN greatest(0, least(1, e/(2*a))) ELSE 0.5 END, CASE WHEN d>0 THEN greatest(0, least(1, f/(2*d))) ELSE 0.5 END FROM qe{t} WHERE a<=0 OR d<=0""",
        f"fit{t}": f"""SELECT {KEY}, from_code, to_code, weight FROM f1{t}
            UNION ALL SELECT {KEY}, from_code, to_code, 1.0 FROM fk{t} JOIN flt USING (period, direction, group_id) JOIN fgr USING (period, direction, group_id) WHERE n_free<=1 AND n_to=1
            UNION ALL SELECT {KEY}, unnest([f1, f1, f2, f2]), unnest([t1, t2, t1, t2]), unnest([p, 1-p, q, 1-q]) FROM qq{t}""",
    }


def bin_parts(n_bins: int) -> dict[str, str]:
    """hbin: the pairs' bins; momb: moments of the shares of all other bins, by bin."""
    pair = "period, direction, measure, group_id, REPORTER, PARTNER"
    return {
        "hbin": f"""SELECT {pair}, CAST((row_number() OVER (PARTITION BY period, direction, measure ORDER BY md5(concat_ws('|', '1', {pair})), group_id, REPORTER, PARTNER)-1)%{n_bins} AS INT) AS bin
            FROM (SELECT DISTINCT {pair} FROM used WHERE measure='VALUE_EUR')""",
        "ub0": f"SELECT s.*, r.bin FROM used s JOIN hbin h USING ({pair}) CROSS JOIN (SELECT unnest(range({n_bins}))::INT AS bin) r WHERE s.measure='VALUE_EUR' AND h.bin<>r.bin",
        "ub1": f"SELECT * REPLACE (value/sum(value) OVER (PARTITION BY {KEY}, side) AS share), sum(CASE WHEN side='a' THEN value ELSE 0 END) OVER (PARTITION BY {KEY}) AS ra, sum(CASE WHEN side='b' THEN value ELSE 0 END) OVER (PARTITION BY {KEY}) AS rb FROM ub0",
        "ub": "SELECT * FROM ub1 WHERE ra>0 AND rb>0",
        "momb": f"""SELECT {KEY}, 'm' AS kind, x.code AS i, y.code AS j, sum(x.share*y.share) AS value FROM ub x JOIN ub y USING ({KEY}, REPORTER, PARTNER) WHERE x.is_from AND y.is_from GROUP BY ALL
            UNION ALL SELECT {KEY}, 'n', x.code, y.code, sum(x.share*y.share) FROM ub x JOIN ub y USING ({KEY}, REPORTER, PARTNER) WHERE x.is_from AND NOT y.is_from GROUP BY ALL""",
    }

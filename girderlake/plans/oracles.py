"""The same rows in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from girderlake.sources.relations import AS_OF, with_relations

_ACTIVE = "('OPEN', 'MONITORING')"
_UNDONE = "('OPEN', 'APPROVED', 'SCHEDULED', 'IN_PROGRESS')"
_FOLD = "lower(strip_accents(coalesce(description, '')))"
_DUE = "CAST(inspected_on + to_months(CAST(cycle_months AS INTEGER)) AS DATE)"
_POINTS = """(CASE WHEN daily_traffic >= 50000 THEN 3 WHEN daily_traffic >= 30000 THEN 2 WHEN daily_traffic >= 10000 THEN 1 ELSE 0 END
  + CASE WHEN heavy >= 8000 THEN 3 WHEN heavy >= 6000 THEN 2 WHEN heavy >= 3000 THEN 1 ELSE 0 END
  + CASE WHEN extra_tenths_km >= 300 THEN 3 WHEN extra_tenths_km >= 150 THEN 2 WHEN extra_tenths_km >= 50 THEN 1 ELSE 0 END
  + CASE alternatives WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN road_class = 'AUTOBAHN' THEN 1 ELSE 0 END)"""
_HEAVY = "coalesce(heavy_daily, CAST(round(daily_traffic * truck_share / 100.0) AS BIGINT))"
_EXPOSED = "(coalesce({d}, 0) >= 2 AND (coalesce(freeze_days, 0) >= 40 OR coalesce(rain_days, 0) >= 8 OR coalesce(deicing_days, 0) >= 25))"

_BAND = "CASE WHEN level_cm >= hhw_cm THEN 'EXTREME' WHEN level_cm >= coalesce(hsw_cm, mark_two_cm) THEN 'HIGH' WHEN level_cm >= coalesce(mhw_cm, mark_one_cm) THEN 'MODERATE' ELSE 'BELOW_TRIGGER' END"

#: Steps that several queries share.
VIEWS = {
    "q_inspections": f"SELECT *, row_number() OVER w AS rn, lead(tenths) OVER w AS previous_tenths, {_DUE} AS due_on FROM {{inspections}} WINDOW w AS (PARTITION BY part_id ORDER BY inspected_on DESC NULLS LAST, id)",
    "q_current": """SELECT part_id, structure_id, id, inspected_on, tenths, previous_tenths, tenths - previous_tenths AS delta_tenths,
      CASE WHEN tenths > previous_tenths THEN 'DETERIORATING' WHEN tenths < previous_tenths THEN 'IMPROVING' WHEN tenths = previous_tenths THEN 'STABLE' ELSE 'UNKNOWN' END AS condition_trend
      FROM {q_inspections} WHERE rn = 1""",
    "q_headline": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY tenths DESC NULLS LAST, inspected_on DESC NULLS LAST, id) AS n FROM {q_current}) WHERE n = 1",
    "q_structure": "SELECT structure_id, count(*) AS n_parts, min(construction_year) AS construction_year, CASE WHEN count(DISTINCT structure_type) > 1 THEN 'Multiple' ELSE min(structure_type) END AS structure_type FROM {parts} GROUP BY 1",
    "q_inspection_summary": "SELECT structure_id, max(inspected_on) AS last_on, min(due_on) AS due_on, count(*) AS n_current, count(due_on) AS n_due FROM {q_inspections} WHERE rn = 1 GROUP BY 1",
    "q_findings": f"SELECT structure_id, count(*) FILTER (WHERE status IN {_ACTIVE}) AS open_findings, max(stability) FILTER (WHERE status IN {_ACTIVE}) AS max_stability, max(safety) FILTER (WHERE status IN {_ACTIVE}) AS max_safety, max(durability) FILTER (WHERE status IN {_ACTIVE}) AS max_durability FROM {{findings}} GROUP BY 1",
    "q_ranked": f"SELECT *, CASE WHEN upper(urgency) IN ('SOFORT', 'UNVERZUEGLICH', 'UNVERZÜGLICH', 'DRINGEND', 'IMMEDIATE') THEN 4 WHEN upper(urgency) IN ('KURZFRISTIG', 'SHORT_TERM') THEN 3 WHEN upper(urgency) IN ('MITTELFRISTIG', 'MEDIUM_TERM') THEN 2 WHEN upper(urgency) IN ('LANGFRISTIG', 'LONG_TERM') THEN 1 ELSE 0 END AS urgency_rank FROM {{recommendations}} WHERE status IN {_UNDONE}",
    "q_headline_rec": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY urgency_rank DESC, coalesce(own_planned_year, target_year) ASC NULLS LAST, id) AS n FROM {q_ranked}) WHERE n = 1",
    "q_traffic": f"SELECT *, {_HEAVY} AS heavy FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY observation_year DESC, observed_on DESC NULLS LAST, id) AS n FROM {{traffic}}) WHERE n = 1",
    "q_network": f"SELECT n.structure_id, heavy, {_POINTS} AS points, extra_tenths_km * daily_traffic AS extra_vehicle_tenths_km FROM {{networks}} n LEFT JOIN {{q_traffic}} t ON n.structure_id = t.structure_id",
    "q_band": "SELECT *, CASE WHEN points >= 8 THEN 'HIGH' WHEN points >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM {q_network}",
    "q_scour": f"SELECT DISTINCT structure_id FROM {{findings}} WHERE status IN {_ACTIVE} AND regexp_matches({_FOLD}, 'kolk|scour|unterspul')",
    "q_sensitive": f"SELECT id AS structure_id FROM {{structures}} s WHERE regexp_matches(lower(crossed), 'bach|tal|fluss|gewässer|gewasser|river') AND (EXISTS (SELECT 1 FROM {{findings}} f WHERE f.structure_id = s.id AND regexp_matches({_FOLD}, 'kolk|scour|unterspul')) OR EXISTS (SELECT 1 FROM {{components}} c WHERE c.structure_id = s.id AND regexp_matches(lower(c.type), 'gründung|grundung|pfahl|widerlager')))",
    "q_unmatched": """SELECT DISTINCT e.structure_id FROM {flood_peaks} e WHERE e.level_cm >= coalesce(e.mhw_cm, e.mark_one_cm, 0)
      AND NOT EXISTS (SELECT 1 FROM {flood_peaks} later WHERE later.structure_id = e.structure_id AND later.peaked_on > e.peaked_on AND later.level_cm >= coalesce(later.mhw_cm, later.mark_one_cm, 0))
      AND NOT EXISTS (SELECT 1 FROM {inspections} i WHERE i.structure_id = e.structure_id AND i.type = 'SPECIAL' AND i.inspected_on >= e.peaked_on AND i.inspected_on < e.peaked_on + INTERVAL 12 MONTH)""",
    "q_flooded": """SELECT g.structure_id FROM {gauges} g JOIN {q_sensitive} s ON s.structure_id = g.structure_id LEFT JOIN {q_unmatched} u ON u.structure_id = g.structure_id
      WHERE g.level_cm >= g.trigger_cm OR u.structure_id IS NOT NULL""",
    "q_deciding": f"""SELECT structure_id, peaked_on, band FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY peaked_on DESC, id) AS n FROM (SELECT *, {_BAND} AS band FROM {{flood_peaks}}) WHERE band <> 'BELOW_TRIGGER') WHERE n = 1""",
    "q_open_flood": """SELECT * FROM {q_deciding} e
      WHERE NOT EXISTS (SELECT 1 FROM {inspections} i WHERE i.structure_id = e.structure_id AND i.type = 'SPECIAL' AND i.inspected_on >= e.peaked_on AND i.inspected_on < e.peaked_on + INTERVAL 12 MONTH)""",
    "q_watched": """SELECT g.structure_id FROM {gauges} g JOIN {q_sensitive} s ON s.structure_id = g.structure_id LEFT JOIN {q_open_flood} u ON u.structure_id = g.structure_id
      WHERE g.level_cm >= g.trigger_cm OR u.structure_id IS NOT NULL""",
    "q_base": f"""SELECT s.id AS structure_id, s.ext_no, s.road, construction_year, tenths, coalesce(condition_trend, 'UNKNOWN') AS condition_trend,
      coalesce(open_findings, 0) AS open_findings, coalesce(open_recommendations, 0) AS open_recommendations, coalesce(urgency_rank, 0) AS urgency_rank,
      coalesce(max_stability, 0) AS ms, coalesce(max_safety, 0) AS mv, coalesce(max_durability, 0) AS md, due_on,
      CASE WHEN due_on < DATE '{AS_OF}' THEN 'OVERDUE' WHEN due_on <= DATE '{AS_OF}' + 180 THEN 'DUE_SOON' WHEN coalesce(n_parts, 0) = 0 OR coalesce(n_due, 0) < n_parts THEN 'UNKNOWN' ELSE 'CURRENT' END AS inspection_status,
      {_POINTS} AS network_points, coalesce(extra_tenths_km * daily_traffic, 0) AS extra_vehicle_tenths_km,
      {_EXPOSED.format(d="max_durability")} AS environment,
      q_flooded.structure_id IS NOT NULL AS flood, q_scour.structure_id IS NOT NULL AS scour
      FROM {{structures}} s LEFT JOIN {{q_structure}} ON q_structure.structure_id = s.id LEFT JOIN {{q_inspection_summary}} ON q_inspection_summary.structure_id = s.id
      LEFT JOIN {{q_headline}} ON q_headline.structure_id = s.id LEFT JOIN {{q_findings}} ON q_findings.structure_id = s.id
      LEFT JOIN (SELECT structure_id, count(*) AS open_recommendations FROM {{q_ranked}} GROUP BY 1) r ON r.structure_id = s.id
      LEFT JOIN {{q_headline_rec}} ON q_headline_rec.structure_id = s.id LEFT JOIN {{q_traffic}} ON q_traffic.structure_id = s.id
      LEFT JOIN {{climates}} ON climates.structure_id = s.id LEFT JOIN {{networks}} ON networks.structure_id = s.id LEFT JOIN {{gauges}} ON gauges.structure_id = s.id
      LEFT JOIN {{q_flooded}} ON q_flooded.structure_id = s.id LEFT JOIN {{q_scour}} ON q_scour.structure_id = s.id""",
    "q_portfolio": """SELECT *, CASE WHEN inspection_status = 'OVERDUE' OR ms >= 3 OR mv >= 3 THEN 5 WHEN ms >= 2 OR mv >= 2 OR network OR (flood AND scour) THEN 4
      WHEN inspection_status IN ('DUE_SOON', 'UNKNOWN') OR tenths IS NULL OR md >= 2 OR environment OR flood OR condition_trend = 'DETERIORATING' OR urgency_rank >= 2 THEN 3
      WHEN open_findings > 0 OR open_recommendations > 0 THEN 2 ELSE 1 END AS attention_priority
      FROM (SELECT *, network_points >= 8 AND (md >= 2 OR ms >= 2 OR mv >= 2 OR condition_trend = 'DETERIORATING' OR urgency_rank >= 2 OR coalesce(tenths, 0) >= 25) AS network FROM {q_base})""",
    "q_delta": "SELECT part_id, max(CASE WHEN n = 1 THEN tenths END) - max(CASE WHEN n = 2 THEN tenths END) AS delta_tenths FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY inspected_on DESC, id) AS n FROM {inspections} WHERE inspected_on IS NOT NULL AND tenths IS NOT NULL) WHERE n <= 2 GROUP BY 1",
    "q_items": f"""SELECT r.id, r.structure_id, r.work_type, r.target_year, p.id AS intervention_id, p.planned_year, p.included, coalesce(p.estimate, r.cost) AS estimate,
      CASE WHEN p.estimate IS NOT NULL THEN 'MANAGERIAL' WHEN r.cost IS NOT NULL THEN 'SOURCE_DOCUMENT' END AS estimate_origin,
      CASE p.status WHEN 'PLANNED' THEN 'planned' WHEN 'BUDGETED' THEN 'budgeted' WHEN 'TENDER_PREPARATION' THEN 'tender' ELSE 'unplanned' END AS view,
      band, extra_vehicle_tenths_km, st, sa, du, urgency, delta_tenths,
      CASE WHEN due_on IS NULL THEN 'UNKNOWN' WHEN due_on < DATE '{AS_OF}' THEN 'OVERDUE' WHEN due_on <= DATE '{AS_OF}' + 180 THEN 'DUE_SOON' ELSE 'CURRENT' END AS status,
      greatest(CAST(date_sub('year', sourced_on, DATE '{AS_OF}') AS BIGINT), 0) AS age, w.structure_id IS NOT NULL AS flood, {_EXPOSED.format(d="du")} AS environment
      FROM {{recommendations}} r LEFT JOIN {{interventions}} p ON p.recommendation_id = r.id LEFT JOIN {{q_inspections}} i ON i.id = r.id
      LEFT JOIN (SELECT inspection_id, max(stability) FILTER (WHERE status IN {_ACTIVE}) AS st, max(safety) FILTER (WHERE status IN {_ACTIVE}) AS sa, max(durability) FILTER (WHERE status IN {_ACTIVE}) AS du FROM {{findings}} GROUP BY 1) f ON f.inspection_id = r.id
      LEFT JOIN {{q_delta}} d ON d.part_id = i.part_id LEFT JOIN {{q_band}} b ON b.structure_id = r.structure_id LEFT JOIN {{climates}} c ON c.structure_id = r.structure_id LEFT JOIN {{q_watched}} w ON w.structure_id = r.structure_id
      WHERE p.id IS NOT NULL OR r.status IN {_UNDONE}""",
    "q_reasons": """SELECT id, sev, place, code FROM (
      SELECT id, CASE WHEN st >= 3 THEN 4 WHEN st >= 2 THEN 3 END AS sev, 1 AS place, 'STABILITY_RATING' AS code FROM {q_items}
      UNION ALL SELECT id, CASE WHEN sa >= 3 THEN 4 WHEN sa >= 2 THEN 3 END, 2, 'TRAFFIC_SAFETY_RATING' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN status = 'OVERDUE' THEN 4 END, 3, 'INSPECTION_OVERDUE' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN upper(urgency) IN ('SOFORT', 'UNVERZÜGLICH', 'IMMEDIATE') THEN 4 END, 4, 'IMMEDIATE_URGENCY' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN du >= 3 THEN 3 WHEN du >= 2 THEN 2 END, 5, 'DURABILITY_RATING' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN upper(urgency) IN ('KURZFRISTIG', 'DRINGEND') THEN 3 END, 6, 'SHORT_TERM_URGENCY' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN delta_tenths >= 1 THEN 3 END, 7, 'CONDITION_DETERIORATING' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN age >= 5 THEN 3 WHEN age >= 2 THEN 2 END, 8, 'LONG_UNRESOLVED' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN status = 'DUE_SOON' THEN 2 END, 9, 'INSPECTION_DUE_SOON' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN urgency = 'MITTELFRISTIG' THEN 2 END, 10, 'MEDIUM_TERM_URGENCY' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN band = 'HIGH' THEN 3 WHEN band = 'MEDIUM' THEN 2 END, 11, 'NETWORK_CRITICALITY' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN flood THEN 3 END, 12, 'POST_FLOOD_INSPECTION' FROM {q_items}
      UNION ALL SELECT id, CASE WHEN environment THEN 2 END, 13, 'HIGH_ENVIRONMENTAL_EXPOSURE' FROM {q_items}) WHERE sev IS NOT NULL""",
    "q_priority": """SELECT i.*, coalesce(top, 1) AS priority, coalesce(reasons, '') AS reasons FROM {q_items} i
      LEFT JOIN (SELECT id, max(sev) AS top, string_agg(code, ',' ORDER BY sev DESC, place) AS reasons FROM {q_reasons} GROUP BY 1) r ON r.id = i.id""",
    "q_budget_items": "SELECT *, CASE WHEN planned_year % 4 <> 0 THEN CAST(planned_year * 20000 AS DECIMAL(16,2)) END AS budget FROM {q_priority} WHERE intervention_id IS NOT NULL",
    "q_funded": """SELECT *, coalesce(running <= budget, false) AS funded FROM (SELECT *, CAST(sum(estimate) OVER (PARTITION BY planned_year
      ORDER BY priority DESC, CASE band WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, coalesce(extra_vehicle_tenths_km, 0) DESC, work_type, id ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS running
      FROM {q_budget_items} WHERE included = 1 AND estimate IS NOT NULL)""",
    "q_index": "SELECT CAST(2004 + row_number() OVER () AS BIGINT) AS year, v FROM (SELECT unnest([784, 801, 843, 890, 896, 905, 932, 958, 971, 983, 1000, 1019, 1056, 1108, 1162, 1194, 1283, 1487, 1625, 1689, 1726]) AS v)",
    "q_scenarios": "SELECT road, min(id) AS scenario_id FROM {structures} GROUP BY 1",
    "q_envelopes": "SELECT scenario_id, year, CASE WHEN (year + scenario_id) % 4 <> 0 THEN CAST(year * 3000 AS DECIMAL(16,2)) END AS budget FROM {q_scenarios}, (SELECT CAST(unnest(range(1998, 2003)) AS BIGINT) AS year)",
    "q_assigned": """SELECT scenario_id, estimate, CASE WHEN asked BETWEEN 1998 AND 2002 THEN asked WHEN i.id % 4 <= 1 AND asked IS NULL THEN NULL WHEN planned_year BETWEEN 1998 AND 2002 THEN planned_year END AS assigned_year
      FROM (SELECT *, CASE WHEN id % 4 = 0 THEN planned_year + 1 END AS asked FROM {interventions}) i JOIN {structures} s ON s.id = i.structure_id JOIN {q_scenarios} ON q_scenarios.road = s.road""",
    "q_assigned_ids": """SELECT scenario_id, id, CASE WHEN asked BETWEEN 1998 AND 2002 THEN asked WHEN id % 4 <= 1 AND asked IS NULL THEN NULL WHEN planned_year BETWEEN 1998 AND 2002 THEN planned_year END AS assigned_year
      FROM (SELECT i.id, i.planned_year, q.scenario_id, CASE WHEN i.id % 4 = 0 THEN planned_year + 1 END AS asked FROM {interventions} i JOIN {structures} s ON s.id = i.structure_id JOIN {q_scenarios} q ON q.road = s.road)""",
    "q_years": """SELECT e.scenario_id, e.year, e.budget, count(a.scenario_id) AS n_items, CAST(coalesce(sum(a.estimate), 0) AS DECIMAL(38,2)) AS value, count(a.scenario_id) - count(a.estimate) AS n_missing
      FROM {q_envelopes} e LEFT JOIN {q_assigned} a ON a.scenario_id = e.scenario_id AND a.assigned_year = e.year GROUP BY 1, 2, 3""",
    "q_finding_health": f"""SELECT s.id AS structure_id, count(DISTINCT f.id) FILTER (WHERE data_origin = 'EXTRACTED' AND EXISTS (SELECT 1 FROM {{finding_evidence}} fe JOIN {{source_evidence}} se ON se.id = fe.evidence_id
        WHERE fe.finding_id = f.id AND se.run_id IS NOT NULL AND se.review_state = 'AUTOMATICALLY_EXTRACTED')) AS n_review,
      count(DISTINCT f.id) FILTER (WHERE data_origin = 'EXTRACTED' AND f.status IN {_ACTIVE} AND greatest(coalesce(stability, 0), coalesce(safety, 0), coalesce(durability, 0)) >= 2
        AND NOT EXISTS (SELECT 1 FROM {{finding_evidence}} fe JOIN {{source_evidence}} se ON se.id = fe.evidence_id
          WHERE fe.finding_id = f.id AND fe.kind = 'SOURCE_FACT' AND se.run_id IS NOT NULL AND se.page IS NOT NULL AND nullif(trim(se.excerpt), '') IS NOT NULL)) AS n_unshown
      FROM {{structures}} s LEFT JOIN {{findings}} f ON f.structure_id = s.id GROUP BY 1""",
    "q_last_runs": "SELECT document_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY attempt DESC, id DESC) AS n FROM {runs}) WHERE n = 1",
    "q_last_processing": "SELECT document_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY attempt DESC, id DESC) AS n FROM {processing}) WHERE n = 1",
    "q_books": r"""SELECT b.structure_id, count(*) FILTER (WHERE r.status = 'FAILED' OR p.status = 'FAILED') AS n_wrong, bool_or(regexp_matches(lower(concat(type, ' ', filename)), 'nachrechnung|tragfähigkeitsnachweis|statische berechnung')) AS load
      FROM {books} b LEFT JOIN {q_last_runs} r ON r.document_id = b.id LEFT JOIN {q_last_processing} p ON p.document_id = b.id WHERE b.structure_id IS NOT NULL GROUP BY 1""",
    "q_health": f"""WITH g AS (SELECT structure_id, count(*) AS n_parts, count(*) FILTER (WHERE length_m IS NULL OR width_m IS NULL OR area_sqm IS NULL OR span_count IS NULL) AS n_bare FROM {{parts}} GROUP BY 1),
      i AS (SELECT structure_id, max(inspected_on) AS last_on FROM {{inspections}} GROUP BY 1), t AS (SELECT structure_id, max(observation_year) AS y FROM {{traffic}} GROUP BY 1),
      r AS (SELECT r.structure_id, count(*) FILTER (WHERE cost IS NULL AND estimate IS NULL) AS n, count(*) FILTER (WHERE r.quantity IS NULL OR unit IS NULL) AS m FROM {{recommendations}} r
        LEFT JOIN {{interventions}} p ON p.recommendation_id = r.id WHERE r.status NOT IN ('COMPLETED', 'CANCELLED') GROUP BY 1),
      b AS (SELECT s.id AS structure_id, n_parts, n_bare, last_on, y, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(n_wrong, 0) AS n_wrong, coalesce(load, false) AS load, n_review, n_unshown
        FROM {{structures}} s LEFT JOIN g ON g.structure_id = s.id LEFT JOIN i ON i.structure_id = s.id LEFT JOIN t ON t.structure_id = s.id LEFT JOIN r ON r.structure_id = s.id
        LEFT JOIN {{q_books}} k ON k.structure_id = s.id JOIN {{q_finding_health}} f ON f.structure_id = s.id)
      SELECT structure_id, 'LATEST_INSPECTION' AS code, CASE WHEN last_on IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS status, CAST(last_on IS NOT NULL AS BIGINT) AS count FROM b
      UNION ALL SELECT structure_id, 'TRAFFIC_CURRENCY', CASE WHEN y IS NULL THEN 'MISSING' WHEN {AS_OF[:4]} - y > 5 THEN 'STALE' ELSE 'CURRENT' END, coalesce(greatest({AS_OF[:4]} - y, 0), 0) FROM b
      UNION ALL SELECT structure_id, 'GEOMETRY_COMPLETENESS', CASE WHEN n_parts IS NULL OR n_bare > 0 THEN 'MISSING' ELSE 'COMPLETE' END, coalesce(CASE WHEN n_bare > 0 THEN n_bare ELSE n_parts END, 0) FROM b
      UNION ALL SELECT structure_id, 'EXTRACTION_ERRORS', CASE WHEN n_wrong > 0 THEN 'ERROR' ELSE 'COMPLETE' END, n_wrong FROM b
      UNION ALL SELECT structure_id, 'RECOMMENDATION_QUANTITIES', CASE WHEN m > 0 THEN 'MISSING' ELSE 'COMPLETE' END, m FROM b
      UNION ALL SELECT structure_id, 'RECOMMENDATION_COST_ESTIMATES', CASE WHEN n > 0 THEN 'MISSING' ELSE 'COMPLETE' END, n FROM b
      UNION ALL SELECT structure_id, 'EXTRACTED_FINDING_REVIEW', CASE WHEN n_review > 0 THEN 'REVIEW_REQUIRED' ELSE 'COMPLETE' END, n_review FROM b
      UNION ALL SELECT structure_id, 'CRITICAL_SOURCE_EVIDENCE', CASE WHEN n_unshown > 0 THEN 'ERROR' ELSE 'COMPLETE' END, n_unshown FROM b
      UNION ALL SELECT structure_id, 'LOAD_RECALCULATION_DOCUMENT', CASE WHEN load THEN 'AVAILABLE' ELSE 'MISSING' END, CAST(load AS BIGINT) FROM b""",
    "q_numbers": r"""SELECT *, CASE WHEN x LIKE '%,%' AND x LIKE '%.%' THEN CASE WHEN regexp_matches(x, '\.[^.]*,[^.]*$') THEN regexp_replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '') END
      WHEN regexp_full_match(x, '\d{{1,3}}(\.\d{{3}})+') THEN replace(x, '.', '') WHEN x LIKE '%,%' THEN regexp_replace(x, ',', '.') ELSE x END AS y,
      CASE WHEN regexp_full_match(x, '\d{{1,3}}([.,]\d{{3}})+') THEN regexp_replace(x, '[.,]', '', 'g') ELSE x END AS z
      FROM (SELECT id, regexp_replace(regexp_replace(number_text, '[\s'']', '', 'g'), '(?i)(m²|m2|qm|stk|stueck|stück|euro|eur|€|m|%)$', '') AS x FROM {raw_values})""".replace("{{", "{").replace("}}", "}"),
    "q_tm": """WITH k AS (SELECT *, east / 1000000 AS e6, CAST(floor(east / 1000000) AS INTEGER) AS zone FROM (SELECT id, CAST(east AS DOUBLE) AS east, CAST(north AS DOUBLE) AS north FROM {points})),
      e AS (SELECT *, CASE WHEN id % 2 = 0 THEN 6378137.0 ELSE 6377397.155 END::DOUBLE AS a, CASE WHEN id % 2 = 0 THEN 1 / 298.257223563::DOUBLE ELSE 1 / 299.1528128::DOUBLE END AS f,
        CASE WHEN id % 2 = 0 THEN 0.9996::DOUBLE ELSE 1::DOUBLE END AS k0, CASE WHEN id % 2 = 0 THEN 500000.0 ELSE zone * 1000000.0 + 500000 END::DOUBLE AS e0, CASE WHEN id % 2 = 0 THEN 9 ELSE zone * 3 END AS lon0 FROM k),
      s AS (SELECT *, f / (2 - f) AS n FROM e), r AS (SELECT *, a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS big FROM s),
      x AS (SELECT *, north / (k0 * big) AS xi, (east - e0) / (k0 * big) AS eta, n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 AS b1, n ** 2 / 48 + n ** 3 / 15 AS b2, 17 * n ** 3 / 480 AS b3 FROM r),
      y AS (SELECT *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) AS p, eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) AS q FROM x),
      z AS (SELECT *, asin(sin(p) / cosh(q)) AS chi FROM y)
      SELECT id, a, f, chi + (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3) * sin(2 * chi) + (7 * n ** 2 / 3 - 8 * n ** 3 / 5) * sin(4 * chi) + 56 * n ** 3 / 15 * sin(6 * chi) AS phi, radians(lon0) + atan(sinh(q) / cos(p)) AS lam FROM z""",
    "q_photo": """SELECT *, CASE WHEN label THEN 12 ELSE 0 END + CASE WHEN view_ THEN 10 WHEN weak AND NOT drawing THEN 5 ELSE 0 END + CASE WHEN number <= 12 AND n BETWEEN 15 AND 220 AND NOT drawing THEN 4 ELSE 0 END
      + CASE WHEN number = 1 AND n <= 350 THEN 2 ELSE 0 END + CASE WHEN by_sight AND number <= 8 AND n <= 200 AND NOT drawing THEN 6 ELSE 0 END - CASE WHEN cover AND NOT label THEN 4 ELSE 0 END - CASE WHEN drawing THEN 15 ELSE 0 END AS score
      FROM (SELECT *, length(regexp_replace(text, '\\s+', '', 'g')) AS n, text LIKE '%Foto 1%' OR text LIKE '%Lichtbild%' AS label, text LIKE '%Bauwerksansicht%' AS view_, regexp_matches(text, '(?i)\\bansicht\\b') AS weak, text LIKE '%Querschnitt%' AS drawing, text LIKE '%Bauwerksbuch%' AS cover FROM {book_pages} WHERE number <= 20)""",
}

SQL = {
    "portfolio_attention": """SELECT structure_id, ext_no, CAST(attention_priority AS BIGINT) AS attention_priority, concat_ws(',',
        CASE inspection_status WHEN 'OVERDUE' THEN 'OVERDUE_INSPECTION' WHEN 'DUE_SOON' THEN 'INSPECTION_DUE_SOON' END, CASE WHEN mv >= 2 THEN 'TRAFFIC_SAFETY_FINDING' END,
        CASE WHEN ms >= 2 THEN 'STABILITY_FINDING' END, CASE WHEN md >= 2 THEN 'DURABILITY_FINDING' END, CASE WHEN environment THEN 'ENVIRONMENTAL_EXPOSURE' END,
        CASE WHEN network THEN 'NETWORK_CRITICALITY' END, CASE WHEN flood THEN 'FLOOD_EXPOSURE' END, CASE WHEN condition_trend = 'DETERIORATING' THEN 'DETERIORATING_CONDITION' END,
        CASE WHEN urgency_rank >= 2 THEN 'MEDIUM_OR_HIGHER_RECOMMENDATION' WHEN open_recommendations > 0 THEN 'OPEN_RECOMMENDATION' END,
        CASE WHEN open_findings > 0 AND greatest(ms, mv, md) < 2 THEN 'OPEN_FINDING' END, CASE WHEN inspection_status = 'UNKNOWN' OR tenths IS NULL THEN 'MISSING_CRITICAL_DATA' END) AS reasons,
        inspection_status, tenths, condition_trend, open_findings, open_recommendations, CAST(network_points AS BIGINT) AS network_points, extra_vehicle_tenths_km FROM {q_portfolio}""",
    "portfolio_page": """SELECT structure_id, road, construction_year, CAST(attention_priority AS BIGINT) AS attention_priority FROM {q_portfolio} WHERE road ILIKE '%machin%' AND construction_year >= 1910 AND open_findings > 0
        ORDER BY attention_priority DESC, extra_vehicle_tenths_km DESC, structure_id LIMIT 10 OFFSET 10""",
    "portfolio_summary": "SELECT count(*) AS n, count(*) FILTER (WHERE inspection_status = 'OVERDUE') AS n_overdue, count(*) FILTER (WHERE greatest(ms, mv) >= 2) AS n_severe, count(*) FILTER (WHERE open_recommendations > 0) AS n_recommended FROM {q_portfolio} WHERE road ILIKE '%b%'",
    "structure_summary": "SELECT * FROM {q_structure}",
    "inspection_summary": "SELECT * FROM {q_inspection_summary}",
    "finding_summary": "SELECT * FROM {q_findings}",
    "current_previous_inspection": "SELECT part_id, id, tenths, previous_tenths, delta_tenths, condition_trend FROM {q_current}",
    "headline_inspection": "SELECT structure_id, id, part_id, tenths, inspected_on FROM {q_headline}",
    "headline_recommendation": "SELECT structure_id, id, CAST(urgency_rank AS BIGINT) AS urgency_rank, target_year FROM {q_headline_rec}",
    "latest_traffic": "SELECT structure_id, id, observation_year, observed_on, daily_traffic FROM {q_traffic}",
    "existential_filters": f"SELECT id, ext_no FROM {{structures}} s WHERE EXISTS (SELECT 1 FROM {{recommendations}} r WHERE r.structure_id = s.id AND r.status IN {_UNDONE} AND lower(urgency) = 'sofort') AND EXISTS (SELECT 1 FROM {{findings}} f WHERE f.structure_id = s.id AND f.status = 'MONITORING')",
    "antijoin_latest_event": "SELECT * FROM {flood_peaks} e WHERE level_cm >= coalesce(mhw_cm, mark_one_cm, 0) AND NOT EXISTS (SELECT 1 FROM {flood_peaks} later WHERE later.structure_id = e.structure_id AND later.peaked_on > e.peaked_on AND later.level_cm >= coalesce(later.mhw_cm, later.mark_one_cm, 0))",
    "interval_antijoin": "SELECT * FROM {flood_peaks} e WHERE NOT EXISTS (SELECT 1 FROM {special_checks} c WHERE c.structure_id = e.structure_id AND c.checked_on >= e.peaked_on AND c.checked_on < e.peaked_on + INTERVAL 12 MONTH)",
    "interval_first_match": """SELECT id, structure_id, peaked_on, check_id, checked_on FROM (SELECT e.*, c.id AS check_id, c.checked_on, row_number() OVER (PARTITION BY e.id ORDER BY c.checked_on, CAST(c.id AS VARCHAR)) AS n
        FROM {flood_peaks} e LEFT JOIN {special_checks} c ON c.structure_id = e.structure_id AND c.checked_on >= e.peaked_on AND c.checked_on < e.peaked_on + INTERVAL 12 MONTH) WHERE n = 1""",
    "scour_regex_semijoin": "SELECT * FROM {q_sensitive}",
    "due_status": f"""SELECT id, due_on, CASE WHEN due_on IS NULL THEN 'UNKNOWN' WHEN due_on < DATE '{AS_OF}' THEN 'OVERDUE' WHEN due_on <= DATE '{AS_OF}' + 180 THEN 'DUE_SOON' ELSE 'CURRENT' END AS due_status,
        CASE WHEN inspected_on IS NULL THEN 0 ELSE greatest(CAST(date_sub('year', inspected_on, DATE '{AS_OF}') AS BIGINT), 0) END AS age_years FROM {{q_inspections}}""",
    "condition_delta_scored": "SELECT * FROM {q_delta}",
    "network_points": "SELECT structure_id, heavy, CAST(points AS BIGINT) AS points, band FROM {q_band}",
    "flood_band": f"SELECT structure_id, {_BAND} AS band FROM {{gauges}}",
    "damage_points": f"""SELECT * FROM (WITH f AS (SELECT structure_id, count(*) AS n_active, max(durability) FILTER (WHERE {_FOLD} LIKE '%riss%') AS crack, max(durability) FILTER (WHERE regexp_matches({_FOLD}, 'freilieg|abplatz|bewehrung|exposed')) AS bare,
          max(durability) FILTER (WHERE regexp_matches({_FOLD}, 'korrosion|beschichtung|rost')) AS coating, max(durability) FILTER (WHERE regexp_matches({_FOLD}, 'entwasser|ablauf|blasen|verstopf|wasserstau|durchfeucht')) AS drain,
          max(durability) FILTER (WHERE {_FOLD} LIKE '%fuge%') AS joint, max(durability) FILTER (WHERE regexp_matches({_FOLD}, 'bewuchs|vegetation')) AS plants, max(durability) FILTER (WHERE regexp_matches({_FOLD}, 'kolk|scour|unterspul')) AS scour
          FROM {{findings}} WHERE status IN {_ACTIVE} GROUP BY 1),
        k AS (SELECT structure_id, min(install_year) AS coated_in, count(*) AS n_steel FROM {{components}} WHERE lower(material) LIKE '%stahl%' OR type = 'Geländer' GROUP BY 1),
        b AS (SELECT s.id AS structure_id, s.crossed, q.construction_year, n_active, crack, bare, coating, drain, joint, plants, scour, coated_in, n_steel, freeze_days, rain_days, deicing_days, wet_dry_cycles, humidity, wet_hours, daily_traffic,
          g.structure_id IS NOT NULL AS gauged, coalesce(level_cm >= trigger_cm, false) AS above, g.structure_id IS NOT NULL AND u.structure_id IS NOT NULL AS open_flood
          FROM {{structures}} s LEFT JOIN {{q_structure}} q ON q.structure_id = s.id LEFT JOIN f ON f.structure_id = s.id LEFT JOIN k ON k.structure_id = s.id LEFT JOIN {{climates}} c ON c.structure_id = s.id
          LEFT JOIN {{q_traffic}} t ON t.structure_id = s.id LEFT JOIN {{gauges}} g ON g.structure_id = s.id LEFT JOIN {{q_open_flood}} u ON u.structure_id = s.id),
        p AS (SELECT *, CASE WHEN 2001 - construction_year >= 50 THEN 2 WHEN 2001 - construction_year >= 40 THEN 1 ELSE 0 END + CASE WHEN freeze_days >= 60 THEN 2 WHEN freeze_days >= 40 THEN 1 ELSE 0 END + CASE WHEN wet_dry_cycles >= 80 THEN 1 ELSE 0 END
            + CASE WHEN deicing_days >= 20 AND daily_traffic >= 30000 THEN 1 ELSE 0 END + CASE WHEN crack >= 2 THEN 2 WHEN crack IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN bare IS NOT NULL THEN 2 ELSE 0 END AS rc,
          CASE WHEN humidity >= 78 THEN 1 ELSE 0 END + CASE WHEN wet_hours >= 1400 THEN 1 ELSE 0 END + CASE WHEN coating >= 2 THEN 2 WHEN coating IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN 2001 - coated_in >= 20 THEN 1 ELSE 0 END AS steel,
          CASE WHEN rain_days >= 12 THEN 2 WHEN rain_days >= 8 THEN 1 ELSE 0 END + CASE WHEN drain >= 2 THEN 2 WHEN drain IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN joint >= 2 THEN 2 WHEN joint IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN plants IS NOT NULL THEN 1 ELSE 0 END AS water,
          CASE WHEN regexp_matches(lower(crossed), 'bach|tal|fluss|gewässer|gewasser|river') THEN 1 ELSE 0 END + CASE WHEN NOT gauged AND rain_days >= 8 THEN 1 ELSE 0 END + CASE WHEN open_flood OR above THEN 2 ELSE 0 END + CASE WHEN scour IS NOT NULL THEN 2 ELSE 0 END AS washed FROM b)
        SELECT structure_id, 'RC_CORROSION' AS kind, CAST(rc AS BIGINT) AS points, CASE WHEN rc >= 4 THEN 'HIGH' WHEN rc >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS band, CASE WHEN n_active > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM p
        UNION ALL SELECT structure_id, 'STEEL_CORROSION', steel, CASE WHEN steel >= 4 THEN 'HIGH' WHEN steel >= 2 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN coating IS NOT NULL THEN 'HIGH' WHEN n_steel > 0 THEN 'MEDIUM' ELSE 'LOW' END FROM p
        UNION ALL SELECT structure_id, 'WATER_INGRESS', water, CASE WHEN water >= 4 THEN 'HIGH' WHEN water >= 2 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN drain IS NOT NULL OR joint IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END FROM p
        UNION ALL SELECT structure_id, 'SCOUR', washed, CASE WHEN scour IS NOT NULL OR open_flood THEN 'HIGH' WHEN washed >= 2 THEN 'MEDIUM' ELSE 'LOW' END, CASE WHEN scour IS NOT NULL OR gauged THEN 'MEDIUM' ELSE 'LOW' END FROM p)""",
    "maintenance_priority": "SELECT id, CAST(priority AS BIGINT) AS priority, CASE priority WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS level, reasons, view, estimate, estimate_origin FROM {q_priority}",
    "planning_list": "SELECT id, CAST(priority AS BIGINT) AS priority, target_year FROM {q_priority} WHERE view = 'unplanned' ORDER BY priority DESC, coalesce(planned_year, target_year, 9007199254740991), id LIMIT 50",
    "planning_views": "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE view = '{v}') AS {v}" for v in ("unplanned", "planned", "budgeted", "tender", "in_progress", "completed", "cancelled")) + " FROM {q_items}",
    "budget_summary": """SELECT b.planned_year, selected, CASE WHEN budget >= selected THEN CAST(budget - selected AS DECIMAL(38,2)) END AS remaining, CASE WHEN budget < selected THEN CAST(selected - budget AS DECIMAL(38,2)) END AS over, n_included, n_missing,
        coalesce(n_funded, 0) AS n_funded, CASE WHEN budget IS NULL THEN 'NOT_SET' WHEN budget < selected THEN 'OVER_BUDGET' ELSE 'WITHIN_BUDGET' END AS budget_status
        FROM (SELECT planned_year, min(budget) AS budget, CAST(coalesce(sum(estimate), 0) AS DECIMAL(38,2)) AS selected, count(*) AS n_included, count(*) - count(estimate) AS n_missing FROM {q_budget_items} WHERE included = 1 GROUP BY 1) b
        LEFT JOIN (SELECT planned_year, count(*) FILTER (WHERE funded) AS n_funded FROM {q_funded} GROUP BY 1) f ON f.planned_year = b.planned_year""",
    "funded_prefix": "SELECT planned_year, id, running, funded FROM {q_funded}",
    "price_index_restatement": """SELECT id, CASE WHEN y < 2025 THEN CAST(((CAST(cost * 100 AS HUGEINT) * 1726 + v // 2) // v) / CAST(100 AS DECIMAL(5,2)) AS DECIMAL(16,2)) END AS amount, CASE WHEN y < 2025 THEN y <> s END AS extrapolated
        FROM (SELECT *, target_year + 8 AS s, least(greatest(target_year + 8, 2005), 2025) AS y FROM {recommendations} WHERE cost IS NOT NULL) r LEFT JOIN {q_index} ON q_index.year = r.y""",
    "scenario_year_spine": "SELECT scenario_id, year, budget, n_items, value, n_missing FROM {q_years}",
    "scenario_totals": """SELECT scenario_id, count(assigned_year) AS n_assigned, count(*) - count(assigned_year) AS n_unassigned, count(*) FILTER (WHERE assigned_year IS NOT NULL AND estimate IS NULL) AS n_missing,
        CAST(coalesce(sum(estimate) FILTER (WHERE assigned_year IS NOT NULL), 0) AS DECIMAL(38,2)) AS value, CAST(coalesce(sum(estimate) FILTER (WHERE assigned_year IS NULL), 0) AS DECIMAL(38,2)) AS backlog FROM {q_assigned} GROUP BY 1""",
    "scenario_compare": """SELECT a.year, a.value AS lo_value, a.budget AS lo_budget, b.value AS hi_value, b.budget AS hi_budget FROM {q_years} a JOIN {q_years} b ON a.year = b.year
        WHERE a.scenario_id = (SELECT min(scenario_id) FROM {q_scenarios}) AND b.scenario_id = (SELECT max(scenario_id) FROM {q_scenarios})""",
    "search_ranked": """SELECT id, ext_no, CAST(CASE WHEN lower(ext_no) = 'customer#00000001' THEN 0 WHEN starts_with(lower(ext_no), 'customer#00000001') THEN 1 WHEN starts_with(lower(road), 'customer#00000001') THEN 2 ELSE 3 END AS BIGINT) AS match_rank, count(*) OVER () AS total
        FROM {structures} WHERE contains(lower(concat(coalesce(ext_no, ''), ' ', coalesce(road, ''), ' ', coalesce(state, ''), ' ', coalesce(crossed, ''))), 'customer#00000001') ORDER BY match_rank, lower(coalesce(ext_no, '')), id LIMIT 10""",
    "history_union": """SELECT structure_id, 'INSPECTION' AS kind, id, inspected_on AS happened_on, type AS title, CAST(NULL AS VARCHAR) AS work_type, CAST(NULL AS BIGINT) AS daily_traffic FROM {inspections}
        UNION ALL SELECT structure_id, 'WORK', id, sourced_on, coalesce(work_type, 'Historical work'), work_type, NULL FROM {recommendations} WHERE status = 'COMPLETED'
        UNION ALL SELECT structure_id, 'TRAFFIC', id, observed_on, concat('Traffic observation ', observation_year), NULL, daily_traffic FROM {traffic}""",
    "evidence_union": """SELECT kind, entity_id, doc_id, page FROM {evidence} UNION ALL SELECT 'INSPECTION', id, id % 500, id % 30 FROM {inspections} WHERE inspected_on IS NOT NULL
        UNION ALL SELECT 'TRAFFIC', id, id % 700, NULL FROM {traffic}""",
    "array_agg_pages": "SELECT d.doc_id, coalesce(n, 0) AS n_evidence, coalesce(pages, '') AS pages FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT page) FILTER (WHERE page IS NOT NULL)), ',') AS pages FROM {evidence} GROUP BY 1) e ON e.doc_id = d.doc_id",
    "provenance_rollup": "SELECT r.id, CASE WHEN n IS NULL THEN 'UNLINKED' WHEN n > 1 THEN 'MIXED' ELSE one END AS origin, coalesce(links, 0) AS links FROM {recommendations} r LEFT JOIN (SELECT entity_id, count(DISTINCT origin) AS n, min(origin) AS one, count(*) AS links FROM {evidence} WHERE kind = 'RECOMMENDATION' GROUP BY 1) e ON e.entity_id = r.id",
    "finding_quality_exists": """SELECT structure_id, count(DISTINCT id) FILTER (WHERE greatest(stability, safety) >= 3 AND shown) AS with_evidence, count(DISTINCT id) FILTER (WHERE greatest(stability, safety) >= 3 AND NOT shown) AS without_evidence
        FROM (SELECT f.*, EXISTS (SELECT 1 FROM {evidence} e WHERE e.entity_id = f.inspection_id AND page IS NOT NULL) AS shown FROM {findings} f) GROUP BY 1""",
    "data_health": "SELECT * FROM {q_health}",
    "document_overview": "SELECT code, count(*) FILTER (WHERE status NOT IN ('AVAILABLE', 'CURRENT', 'COMPLETE')) AS n_attention, CAST(sum(count) AS BIGINT) AS total FROM {q_health} GROUP BY 1",
    "eligible_antijoin": "SELECT id, work_type FROM {recommendations} r WHERE status <> 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM {interventions} i WHERE i.recommendation_id = r.id)",
    "parse_decimals": r"""SELECT id, CASE WHEN regexp_full_match(y, '(0|[1-9]\d*)(\.\d+)?') THEN y END AS plain, CASE WHEN regexp_full_match(y, '-?(0|[1-9]\d*)(\.\d+)?') THEN y END AS signed, CASE WHEN regexp_full_match(z, '-?(0|[1-9]\d*)') THEN try_cast(z AS BIGINT) END AS whole FROM {q_numbers}""",
    "parse_dates": r"""SELECT id, CASE WHEN regexp_matches(date_text, '^\d+\.\d+\.\d+$') THEN CAST(try_strptime(date_text, '%d.%m.%Y') AS DATE) ELSE CAST(try_strptime(date_text, '%Y-%m-%d') AS DATE) END AS day FROM {raw_values}""",
    "unit_inference": r"""SELECT id, CASE trim(unit_text) WHEN 'lfd m' THEN 'm' WHEN 'm²' THEN 'm2' WHEN 'Stück' THEN 'Stk' WHEN 'QM' THEN 'm2' WHEN '' THEN NULL ELSE trim(unit_text) END AS unit,
        CASE work_text WHEN '12 lfd m Fuge' THEN 'm' WHEN '3 m² Beton' THEN 'm2' WHEN 'pauschal' THEN 'pauschal' WHEN '4 Stück Lager' THEN 'Stk' WHEN 'Breite 5 mm' THEN 'mm' END AS shown,
        CASE upper(regexp_replace(currency_text, '[.\s]', '', 'g')) WHEN '€' THEN 'EUR' WHEN 'EURO' THEN 'EUR' WHEN 'USD' THEN 'USD' END AS currency FROM {raw_values}""",
    "classify_status": r"""SELECT id, CASE WHEN type_text = 'OTHER' THEN 'OTHER' WHEN lower(type_text) LIKE '%haupt%' THEN 'MAIN' WHEN lower(type_text) LIKE '%einfach%' THEN 'SIMPLE' WHEN lower(type_text) LIKE '%sonder%' THEN 'SPECIAL' END AS type,
        CASE WHEN finding_text = 'RESOLVED' THEN 'RESOLVED' WHEN lower(finding_text) LIKE '%offen%' THEN 'OPEN' WHEN lower(finding_text) LIKE '%beobacht%' THEN 'MONITORING' WHEN lower(finding_text) LIKE '%behoben%' THEN 'RESOLVED' WHEN lower(finding_text) LIKE '%verworfen%' THEN 'DISMISSED' END AS state,
        CASE WHEN u LIKE '%sofort%' THEN 'SOFORT' WHEN u LIKE '%kurzfrist%' THEN 'KURZFRISTIG' WHEN u LIKE '%mittelfrist%' THEN 'MITTELFRISTIG' WHEN u LIKE '%langfrist%' THEN 'LANGFRISTIG' ELSE urgency_text END AS urgency,
        CASE WHEN trim(rating_text) = '' THEN 0 WHEN x = floor(x) AND x BETWEEN 0 AND 4 THEN CAST(x AS BIGINT) END AS rating
        FROM (SELECT *, lower(regexp_replace(urgency_text, '[\s_\-./]+', '', 'g')) AS u, try_cast(replace(trim(rating_text), ',', '.') AS DOUBLE) AS x FROM {raw_values})""",
    "report_inspectors": r"""SELECT document_id, inspected_on, inspector, number FROM (SELECT *, row_number() OVER (PARTITION BY document_id, inspected_on ORDER BY number, id, place) AS n FROM (
        SELECT document_id, number, id, place, CAST(try_strptime(day, '%d.%m.%Y') AS DATE) AS inspected_on,
          regexp_replace(trim(regexp_replace(string_split_regex(coalesce(nullif(regexp_extract(left(after, 220), label, 1), ''), nullif(regexp_extract(right(before, 80), label, 1), '')), '\s{2,}|\s+(?i:Hauptprüfung|Einfache Prüfung|Sonderprüfung|Zustandsnote|Version|Seite)\b')[1], '\s+', ' ', 'g')), '[.,;:\s]+$', '') AS inspector
        FROM (SELECT *, days[place] AS day, parts[place] AS before, parts[place + 1] AS after, 'Pr[üu]fer(?:in)?[:.]?\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß. \-,/]{1,80})' AS label
          FROM (SELECT *, unnest(range(1, len(days) + 1)) AS place FROM (SELECT *, regexp_extract_all(text, '\d{1,2}\.\d{1,2}\.\d{4}') AS days, string_split_regex(text, '\d{1,2}\.\d{1,2}\.\d{4}') AS parts FROM {report_pages}))))
        WHERE inspected_on IS NOT NULL AND length(inspector) >= 2) WHERE n = 1""",
    "document_kinds": """SELECT id, told LIKE '%DRAWING%' OR told LIKE '%ZEICHNUNG%' OR told LIKE '%BAUWERKSPLAN%' OR told LIKE '%BESTANDSPLAN%' AS is_drawing, told LIKE '%PHOTO%' OR told LIKE '%FOTO%' OR told LIKE '%BILD%' AS is_photo,
        CASE WHEN length(land) = 2 THEN land WHEN land IN ('DEUTSCHLAND', 'GERMANY', 'D') THEN 'DE' END AS country
        FROM (SELECT id, upper(concat_ws(' ', type, filename)) AS told, upper(trim(country)) AS land FROM {filed})""",
    "repaired_findings": r"""SELECT id, CASE WHEN id % 3 = 0 THEN concat(id, ',', id + 7) WHEN has_field AND id % 4 = 0 THEN concat(id + 1, ',', id + 2) WHEN id % 5 <> 0 THEN CAST(id + 3 AS VARCHAR) ELSE CAST(id + 5 AS VARCHAR) END AS evidence,
        CASE WHEN has_field THEN rating END AS stability, CASE WHEN has_field AND rating IS NOT NULL AND id % 4 = 0 THEN concat(id + 1, ',', id + 2) ELSE '' END AS stability_evidence,
        state AS status, CASE WHEN state IS NOT NULL AND id % 5 <> 0 THEN CAST(id + 3 AS VARCHAR) ELSE '' END AS status_evidence
        FROM (SELECT id, id % 7 <> 3 AS has_field, CASE WHEN trim(rating_text) = '' THEN 0 WHEN x = floor(x) AND x BETWEEN 0 AND 4 THEN CAST(x AS BIGINT) END AS rating,
          CASE WHEN finding_text = 'RESOLVED' THEN 'RESOLVED' WHEN lower(finding_text) LIKE '%offen%' THEN 'OPEN' WHEN lower(finding_text) LIKE '%beobacht%' THEN 'MONITORING' WHEN lower(finding_text) LIKE '%behoben%' THEN 'RESOLVED' WHEN lower(finding_text) LIKE '%verworfen%' THEN 'DISMISSED' END AS state
          FROM (SELECT *, try_cast(replace(trim(rating_text), ',', '.') AS DOUBLE) AS x FROM {raw_values}))
        WHERE id % 3 = 0 OR (has_field AND id % 4 = 0) OR id % 5 <> 0 OR id % 10 = 0""",
    "text_features": r"""SELECT doc_id, n_compact, n_lines, n_short, n_compact < 40 OR n_broken * 50 > n_all OR (n_lines >= 10 AND n_short * 10 >= n_lines * 7) AS by_sight
        FROM (SELECT doc_id, length(regexp_replace(t, '[ \t\n\r\f\x0B]', '', 'g')) AS n_compact, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS n_lines,
          len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND length(trim(x)) < 25)) AS n_short, length(t) AS n_all, length(t) - length(replace(t, '�', '')) AS n_broken FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "regex_rows": r"""SELECT page_id, number, stability, safety, durability FROM (SELECT *, row_number() OVER (PARTITION BY page_id, number ORDER BY place) AS n FROM (
        SELECT id AS page_id, place, CAST(regexp_extract(m, '\[(\d+)\]', 1) AS BIGINT) AS number, CAST(regexp_extract(m, 'S=(\d)', 1) AS BIGINT) AS stability, CAST(regexp_extract(m, 'V=(\d)', 1) AS BIGINT) AS safety, CAST(regexp_extract(m, 'D=(\d)', 1) AS BIGINT) AS durability
        FROM (SELECT id, unnest(ms) AS m, unnest(range(len(ms))) AS place FROM (SELECT id, regexp_extract_all(page_text, '\[\d+\] S=[0-4], V=[0-4], D=[0-4]') AS ms FROM {raw_values})))) WHERE n = 1""",
    "keep_first": "SELECT part_id, description, min(id) AS id FROM {findings} WHERE description IS NOT NULL GROUP BY 1, 2",
    "coalesce_merge": "SELECT structure_id, arg_min(urgency, id) FILTER (WHERE urgency IS NOT NULL) AS urgency, arg_min(cost, id) FILTER (WHERE cost IS NOT NULL) AS cost, arg_min(target_year, id) FILTER (WHERE target_year IS NOT NULL) AS target_year, count(*) AS n_merged FROM {recommendations} GROUP BY 1",
    "identity_keys": "SELECT id, concat('structure:', substr(sha256(concat('=', lower(ext_no), '|=', lower(road), '|', CASE WHEN crossed IS NULL THEN '~' ELSE concat('=', lower(crossed)) END)), 1, 32)) AS identity FROM {structures}",
    "reconcile_actions": """SELECT id, CASE WHEN id % 10 = 1 THEN 'INSERT' WHEN id % 10 = 0 THEN 'STALE' WHEN id % 7 = 0 AND coalesce(urgency, '~') <> 'x' THEN 'UPDATE' ELSE 'UNCHANGED' END AS action FROM {recommendations}
        UNION ALL SELECT -1 - id, CASE id % 10 WHEN 0 THEN 'INSERT' ELSE 'STALE' END FROM {recommendations} WHERE id % 10 <= 1""",
    "chunk_islands": """SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1) // 2 AS chunk FROM (
        SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn + turn // 3 AS turn FROM conversations WHERE turn IS NOT NULL))) GROUP BY conv_id, run, chunk""",
    "page_labels": """SELECT id, nullif(coalesce(nullif(regexp_extract(x, '(?i)bauwerks(?:nummer|-?nr\\.?)\\D{0,20}(\\d{5,8})', 1), ''), regexp_extract(x, '(?i)nummer\\s+stra(?:ss|ß)e\\s+ibwnr\\s+(\\d{5,8})', 1)), '') AS structure_number,
        nullif(regexp_extract(x, '\\b([ABLK]\\s?\\d{1,4})\\b', 1), '') AS road,
        array_to_string(list_filter([CASE WHEN regexp_matches(text, '\\[\\d+\\]\\s*S\\s*=|(?i:7\\.4\\s+Sch[äa]den)') THEN 'FINDINGS_DAMAGE' END, CASE WHEN regexp_matches(text, 'Ma[sß]nahmenempfehlung\\s*\\{|(?i:Dringlichkeit\\s+\\S+|7\\.6\\s+Empfehlungen)') THEN 'RECOMMENDATIONS' END,
          CASE WHEN regexp_matches(text, '(?:Hauptprüfung|Einfache Prüfung|Sonderprüfung)\\s+\\d{1,2}\\.\\d{1,2}\\.\\d{4}|(?i:7\\.3\\s+Durchgef[üu]hrte Pr[üu]fungen)') THEN 'INSPECTIONS' END], lambda c: c IS NOT NULL), ',') AS categories,
        concat(coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(translate(string_split(replace(filename, chr(92), '/'), '/')[-1], 'äöüÄÖÜàâáçéèêëîïíôóûùúñ', 'aouAOUaaaceeeeiiioouuun'), '\\.pdf$', '', 'i'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), 1, 176), ''), 'bauwerksbuch'), '.pdf') AS filename,
        CASE WHEN regexp_matches(url, '^(?i:https?)://[^\\s/]+') THEN concat(string_split(url, '#')[1], '#page=', number) END AS url
        FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM {book_pages})""",
    "scenario_autofill": """SELECT * FROM (WITH RECURSIVE asked AS (SELECT i.*, q.scenario_id, CASE WHEN id % 4 = 0 THEN planned_year + 1 END AS wish FROM (SELECT i.*, s.road FROM {interventions} i JOIN {structures} s ON s.id = i.structure_id) i JOIN {q_scenarios} q ON q.road = i.road),
        wanted AS (SELECT a.scenario_id, a.id, coalesce(a.id % 4 = 0 AND wish BETWEEN 1998 AND 2002, false) AS locked, CASE WHEN wish BETWEEN 1998 AND 2002 THEN wish WHEN a.planned_year BETWEEN 1998 AND 2002 THEN a.planned_year ELSE 1998 END AS preferred,
          a.estimate, p.priority, p.work_type FROM asked a JOIN {q_priority} p ON p.id = a.id AND p.intervention_id IS NOT NULL),
        lined AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY locked DESC, priority DESC, work_type, id) AS n FROM wanted),
        step AS (SELECT scenario_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS assigned_year, false AS locked, list(CAST(budget AS DECIMAL(38,2)) ORDER BY year) AS rooms FROM {q_envelopes} GROUP BY 1
          UNION ALL SELECT scenario_id, n, id, y, locked, list_transform(range(1, 6), lambda k: CASE WHEN y = k + 1997 AND estimate IS NOT NULL THEN CAST(rooms[k] - estimate AS DECIMAL(38,2)) ELSE rooms[k] END)
          FROM (SELECT l.*, s.rooms, CASE WHEN l.locked THEN l.preferred ELSE list_min(list_filter(range(l.preferred, 2003), lambda v: s.rooms[v - 1997] >= l.estimate)) END AS y FROM step s JOIN lined l ON l.scenario_id = s.scenario_id AND l.n = s.n + 1))
        SELECT scenario_id, id, assigned_year, CASE WHEN locked THEN 'USER_OVERRIDE' ELSE 'AUTO_FILL' END AS source FROM step WHERE n > 0)""",
    "upsert_programme": """SELECT * FROM (WITH y AS (SELECT DISTINCT planned_year FROM {interventions}), new AS (SELECT planned_year + 2 AS planned_year FROM y)
        SELECT coalesce(y.planned_year, new.planned_year) AS planned_year, CAST(CASE WHEN new.planned_year IS NOT NULL THEN 250 ELSE 100 END AS BIGINT) AS amount FROM y FULL JOIN new ON y.planned_year = new.planned_year)""",
    "expectation_violations": """SELECT relation, rule, n FROM (
        SELECT 'parts' AS relation, 'length_positive' AS rule, count(*) AS n FROM {parts} WHERE length_m <= 10 UNION ALL SELECT 'parts', 'span_count_set', count(*) FROM {parts} WHERE span_count IS NULL
        UNION ALL SELECT 'inspections', 'score_in_range', count(*) FROM {inspections} WHERE tenths NOT BETWEEN 10 AND 38 UNION ALL SELECT 'inspections', 'dated', count(*) FROM {inspections} WHERE inspected_on IS NULL
        UNION ALL SELECT 'recommendations', 'urgency_known', count(*) FROM {recommendations} WHERE urgency IS NULL UNION ALL SELECT 'recommendations', 'cost_and_target', count(*) FROM {recommendations} WHERE (cost IS NULL) <> (target_year IS NULL)
        UNION ALL SELECT 'traffic', 'year_of_date', count(*) FROM {traffic} WHERE year(observed_on) <> observation_year UNION ALL SELECT 'traffic', 'share', count(*) FROM {traffic} WHERE truck_share > 18) WHERE n > 0""",
    "projected_coordinates": """SELECT * FROM (WITH g AS (SELECT *, f * (2 - f) AS e2 FROM {q_tm}), c AS (SELECT *, a / sqrt(1 - e2 * sin(phi) ** 2) AS nu FROM g),
        x AS (SELECT *, nu * cos(phi) * cos(lam) AS x0, nu * cos(phi) * sin(lam) AS y0, nu * (1 - e2) * sin(phi) AS z0, radians(0.202 / 3600) AS rx, radians(0.045 / 3600) AS ry, radians(-2.455 / 3600) AS rz FROM c),
        h AS (SELECT *, 598.1 + 1.0000067 * (x0 - rz * y0 + ry * z0) AS x, 73.7 + 1.0000067 * (rz * x0 + y0 - rx * z0) AS y, 418.2 + 1.0000067 * (rx * y0 - ry * x0 + z0) AS z FROM x),
        w AS (SELECT *, 6378137.0::DOUBLE AS aw, 6378137.0::DOUBLE * (1 - 1 / 298.257223563::DOUBLE) AS bw, sqrt(x * x + y * y) AS p FROM h),
        t AS (SELECT *, 1 - bw * bw / (aw * aw) AS ew, atan2(z * aw, p * bw) AS th FROM w)
        SELECT id, CAST(round(degrees(CASE WHEN id % 2 = 0 THEN phi ELSE atan2(z + ew / (1 - ew) * bw * sin(th) ** 3, p - ew * aw * cos(th) ** 3) END) * 100000) AS BIGINT) AS latitude_e5,
          CAST(round(degrees(CASE WHEN id % 2 = 0 THEN lam ELSE atan2(y, x) END) * 100000) AS BIGINT) AS longitude_e5 FROM t)""",
    "photo_page": "SELECT document_id, number, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, number, id) AS rn FROM {q_photo} WHERE score >= 5) WHERE rn = 1",
    "latest_runs": """SELECT l.document_id, l.id AS run_id, l.status, d.id AS finished_id, m + 1 AS next_attempt, l.status = 'FAILED' AS failed
        FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY attempt DESC, id DESC) AS n, max(attempt) OVER (PARTITION BY document_id) AS m FROM {runs}) l
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY attempt DESC, id DESC) AS n FROM {runs} WHERE status IN ('SUCCEEDED', 'FAILED')) d ON d.document_id = l.document_id AND d.n = 1 WHERE l.n = 1""",
    "bad_transitions": """SELECT document_id, id, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY document_id ORDER BY attempt, id) AS before FROM {runs}) WHERE NOT coalesce(CASE before WHEN 'PENDING' THEN status IN ('CLASSIFYING', 'FAILED')
        WHEN 'CLASSIFYING' THEN status IN ('EXTRACTING', 'FAILED') WHEN 'EXTRACTING' THEN status IN ('VALIDATING', 'FAILED') WHEN 'VALIDATING' THEN status IN ('PERSISTING', 'FAILED') WHEN 'PERSISTING' THEN status IN ('SUCCEEDED', 'FAILED') END, before IS NULL AND status = 'PENDING')""",
    "model_usage": "SELECT document_id, count(*) AS n_runs, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(CASE WHEN count(DISTINCT currency) <= 1 THEN sum(cost_micros) END AS BIGINT) AS cost_micros, count(DISTINCT currency) > 1 AS mixed_currency FROM {runs} GROUP BY 1",
    "work_package_readiness": """SELECT * FROM (WITH p AS (SELECT i.id, i.estimate, q.due_on, EXISTS (SELECT 1 FROM {evidence} e WHERE e.entity_id = i.id) AS seen, EXISTS (SELECT 1 FROM {networks} n WHERE n.structure_id = i.structure_id) AS known
          FROM {interventions} i LEFT JOIN {q_inspections} q ON q.id = i.id WHERE i.status = 'TENDER_PREPARATION'),
        r AS (SELECT id, unnest(['SOURCE_EVIDENCE_AVAILABLE', 'QUANTITIES_KNOWN', 'CURRENT_INSPECTION_AVAILABLE', 'COST_ESTIMATE_AVAILABLE', 'DRAWINGS_AVAILABLE', 'TRAFFIC_MANAGEMENT_REQUIREMENTS_KNOWN', 'SITE_VERIFICATION_REQUIRED']) AS code,
          unnest([seen, id % 2 = 0, coalesce(due_on >= DATE '2001-09-01', false), estimate IS NOT NULL, id % 4 = 1, known, NULL]) AS ok FROM p)
        SELECT id, code, CASE WHEN code = 'SITE_VERIFICATION_REQUIRED' THEN 'REQUIRED' WHEN ok THEN 'AVAILABLE' ELSE 'MISSING' END AS state FROM r)""",
    "traffic_management": """SELECT n.structure_id, concat(CASE WHEN extra_tenths_km >= 150 OR alternatives = 0 THEN 'Weiträumige Umleitung' WHEN extra_tenths_km >= 50 THEN 'Örtliche Umleitung' ELSE 'Local traffic management' END,
        ' required (additional ', extra_tenths_km // 10, '.', extra_tenths_km % 10, ' km).', CASE alternatives WHEN 0 THEN ' No comparable-class alternative crossing.' WHEN 1 THEN ' 1 comparable-class alternative crossing.' ELSE concat(' ', alternatives, ' comparable-class alternative crossings.') END,
        CASE WHEN heavy >= 3000 THEN concat(' Diversion must be HGV-capable (', format('{:,}', heavy), ' heavy vehicles/day).') ELSE '' END) AS requirement FROM {networks} n LEFT JOIN {q_traffic} t ON t.structure_id = n.structure_id""",
    "natural_key_enrichment": "SELECT id, ext_no, CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN CASE WHEN id % 5 <> 0 THEN 51 END WHEN id % 3 = 0 THEN id % 90 END AS latitude, CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN CASE WHEN id % 5 <> 0 THEN 7 END WHEN id % 4 = 0 THEN id % 180 END AS longitude FROM {structures}",
    "plan_intervention_outcomes": """SELECT c.id + 500 AS recommendation_id, CASE WHEN r.id IS NULL THEN 'NOT_FOUND' WHEN r.status = 'COMPLETED' THEN 'NOT_ACTIONABLE' WHEN i.id IS NOT NULL THEN 'ALREADY_EXISTS' ELSE 'CREATED' END AS outcome
        FROM {recommendations} c LEFT JOIN {recommendations} r ON r.id = c.id + 500 LEFT JOIN {interventions} i ON i.recommendation_id = c.id + 500""",
    "membership_toggle": """SELECT id, CASE outcome WHEN 'INCLUDED' THEN 'BUDGETED' WHEN 'REMOVED' THEN 'PLANNED' ELSE status END AS status, outcome FROM (SELECT *, CASE WHEN id % 2 <> 0 THEN 'UNTOUCHED' WHEN id % 10 = 0 THEN 'YEAR_MISMATCH'
        WHEN id % 4 = 0 AND status = 'PLANNED' THEN 'INCLUDED' WHEN id % 4 <> 0 AND status = 'BUDGETED' THEN 'REMOVED' ELSE 'NOT_ALLOWED' END AS outcome FROM {interventions})""",
    "scenario_seed": "SELECT scenario_id, i.id, CASE WHEN planned_year BETWEEN 1998 AND 2002 THEN planned_year END AS assigned_year, 'SEEDED' AS source FROM {interventions} i JOIN {structures} s ON s.id = i.structure_id JOIN {q_scenarios} q ON q.road = s.road",
    "scenario_adopt": """SELECT id, CASE WHEN moved AND y IS NOT NULL THEN y ELSE planned_year END AS planned_year, CASE WHEN moved AND y IS NOT NULL THEN 'BUDGETED' WHEN moved THEN 'PLANNED' ELSE status END AS status
        FROM (SELECT *, status IN ('PLANNED', 'BUDGETED') AS moved, CASE WHEN id % 4 = 0 AND planned_year + 1 BETWEEN 1998 AND 2002 THEN planned_year + 1 WHEN id % 4 = 1 THEN NULL WHEN planned_year BETWEEN 1998 AND 2002 THEN planned_year END AS y FROM {interventions})""",
    "replace_pages": """SELECT document_id, number, length(text) AS size FROM {book_pages} WHERE document_id % 3 <> 0 UNION ALL SELECT document_id, number, 0 FROM {book_pages} WHERE document_id % 3 = 0 AND number <= 2
        UNION ALL SELECT document_id, number, length(text) FROM {book_pages} p WHERE document_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM {book_pages} n WHERE n.document_id = p.document_id AND n.number <= 2)""",
    "checksum_duplicates": "SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "previous_year_companion": "SELECT structure_id, observation_year, daily, previous_year, previous_value FROM (SELECT *, lead(observation_year) OVER w AS previous_year, lead(daily) OVER w AS previous_value, row_number() OVER w AS n FROM (SELECT structure_id, observation_year, max(daily_traffic) AS daily FROM {traffic} GROUP BY 1, 2) WINDOW w AS (PARTITION BY structure_id ORDER BY observation_year DESC)) WHERE n = 1",
    "flood_exposure": f"""SELECT structure_id, CASE WHEN NOT watch THEN band WHEN NOT above THEN coalesce(event_band, 'MODERATE') WHEN band = 'BELOW_TRIGGER' THEN 'MODERATE' ELSE band END AS band, watch, above AS trigger_exceeded,
        prone AS scour_sensitive, open_scour, unmatched, CASE WHEN prone AND unmatched THEN 'EXTRAORDINARY_INSPECTION' END AS action, CASE WHEN prone AND unmatched THEN year(event_on) END AS event_year, CASE WHEN prone AND unmatched THEN event_on END AS peaked_on,
        concat_ws(',', 'NEAREST_GAUGE', CASE WHEN water THEN 'WATERCOURSE' END, CASE WHEN washed THEN 'SCOUR_HISTORY' WHEN founded AND water THEN 'FOUNDATION_TYPE' END, CASE WHEN above THEN 'TRIGGER_EXCEEDED' END, CASE WHEN unmatched THEN 'UNMATCHED_FLOOD_EVENT' END) AS reasons
      FROM (SELECT *, water AND (washed OR founded) AS prone, water AND (washed OR founded) AND (above OR unmatched) AS watch FROM (SELECT g.structure_id, {_BAND} AS band, coalesce(level_cm >= trigger_cm, false) AS above,
        coalesce(regexp_matches(lower(crossed), 'bach|tal|fluss|gewässer|gewasser|river'), false) AS water, EXISTS (SELECT 1 FROM {{findings}} f WHERE f.structure_id = g.structure_id AND regexp_matches({_FOLD}, 'kolk|scour|unterspul')) AS washed,
        EXISTS (SELECT 1 FROM {{components}} c WHERE c.structure_id = g.structure_id AND regexp_matches(lower(c.type), 'gründung|grundung|pfahl|widerlager')) AS founded, o.structure_id IS NOT NULL AS open_scour,
        e.band AS event_band, e.peaked_on AS event_on, u.structure_id IS NOT NULL AS unmatched FROM {{gauges}} g JOIN {{structures}} s ON s.id = g.structure_id
        LEFT JOIN {{q_scour}} o ON o.structure_id = g.structure_id LEFT JOIN {{q_deciding}} e ON e.structure_id = g.structure_id LEFT JOIN {{q_open_flood}} u ON u.structure_id = g.structure_id))""",
    "condition_bands": "SELECT CAST(year(inspected_on) AS BIGINT) AS year, CASE WHEN tenths <= 19 THEN 'good' WHEN tenths <= 24 THEN 'fair' WHEN tenths <= 29 THEN 'poor' ELSE 'severe' END AS band, count(*) AS n FROM {inspections} WHERE inspected_on IS NOT NULL AND tenths BETWEEN 10 AND 40 GROUP BY 1, 2",
    "budget_years": "SELECT planned_year AS year FROM {interventions} UNION SELECT target_year FROM {recommendations} WHERE target_year IS NOT NULL UNION SELECT 2026",
    "evidence_sources": "SELECT doc_id, page, count(DISTINCT entity_id) AS n_entities, string_agg(DISTINCT origin, '+' ORDER BY origin) AS origins FROM {evidence} GROUP BY 1, 2",
    "finding_links": """SELECT id AS page_id, id AS number, id % 5 AS stability, id % 4 AS safety, id % 3 AS durability FROM {raw_values} UNION ALL SELECT id, id + 1, NULL, NULL, NULL FROM {raw_values}""",
    "pair_repair": r"""SELECT id, CASE WHEN unit IS NOT NULL THEN plain END AS quantity, CASE WHEN plain IS NOT NULL THEN unit END AS unit, CASE WHEN plain IS NOT NULL THEN coalesce(currency, 'EUR') END AS currency, coalesce(state, 'OPEN') AS state FROM (
        SELECT n.id, CASE WHEN regexp_full_match(y, '(0|[1-9]\d*)(\.\d+)?') THEN y END AS plain, CASE trim(unit_text) WHEN 'lfd m' THEN 'm' WHEN 'm²' THEN 'm2' WHEN 'Stück' THEN 'Stk' WHEN 'QM' THEN 'm2' WHEN '' THEN NULL ELSE trim(unit_text) END AS unit,
          CASE upper(regexp_replace(currency_text, '[.\s]', '', 'g')) WHEN '€' THEN 'EUR' WHEN 'EURO' THEN 'EUR' WHEN 'USD' THEN 'USD' END AS currency,
          CASE WHEN finding_text = 'RESOLVED' THEN 'RESOLVED' WHEN finding_text LIKE '%offen%' THEN 'OPEN' WHEN finding_text LIKE '%Beobacht%' THEN 'MONITORING' WHEN finding_text LIKE '%behoben%' THEN 'RESOLVED' WHEN finding_text LIKE '%verworfen%' THEN 'DISMISSED' END AS state
        FROM {q_numbers} n JOIN {raw_values} r ON r.id = n.id)""",
    "month_series": """SELECT structure_id, CAST(m AS BIGINT) AS month, base + m AS a, CASE WHEN structure_id % 5 = 0 THEN 0 ELSE structure_id % 7 * m END AS b FROM {monthly}, (SELECT unnest(range(1, 13)) AS m) WHERE base IS NOT NULL AND NOT short""",
    "fingerprints": r"""SELECT id, sha256(concat('{"cost":', CASE WHEN cost IS NULL THEN 'null' ELSE concat('"', rtrim(rtrim(CAST(cost AS VARCHAR), '0'), '.'), '"') END, ',"day":"', CAST(sourced_on AS VARCHAR), '","urgency":', CASE WHEN urgency IS NULL THEN 'null' ELSE concat('"', urgency, '"') END, '}')) AS fingerprint FROM {recommendations}""",
    "linked_findings": """SELECT r.id, CASE WHEN n IS NOT NULL THEN coalesce(labels, '') END AS labels, worst, n, inspected_on FROM {recommendations} r LEFT JOIN (SELECT inspection_id, array_to_string(list_sort(list(DISTINCT description) FILTER (WHERE description IS NOT NULL))[1:3], '; ') AS labels, max(greatest(stability, safety, durability)) AS worst, count(*) AS n FROM {findings} GROUP BY 1) f ON f.inspection_id = r.id
        LEFT JOIN {inspections} i ON i.id = r.id""",
    "evidence_dedup": "SELECT doc_id, origin, slot, page, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, origin, slot ORDER BY page DESC NULLS LAST, entity_id DESC) AS n FROM (SELECT *, entity_id % 100 AS slot FROM {evidence})) WHERE n = 1",
    "parent_repair": "SELECT r.id, CASE WHEN p.id IS NULL THEN r.structure_id * 10 ELSE p.id END AS part_id, p.id IS NULL AS repaired FROM {recommendations} r LEFT JOIN {parts} p ON p.id = r.structure_id * 10 + r.id % 3",
    "finding_descriptions": """SELECT id AS page_id, CAST(1 AS BIGINT) AS n, id AS number, 'Riss.' AS description FROM {raw_values} UNION ALL SELECT id, 2, id + 1, 'x' FROM {raw_values} UNION ALL SELECT id, 3, id, NULL FROM {raw_values}""",
    "pages_by_category": """SELECT document_id, CASE id % 11 WHEN 5 THEN 'FINDINGS_DAMAGE' WHEN 6 THEN 'INSPECTIONS' ELSE 'RECOMMENDATIONS' END AS category, array_to_string(list_sort(list(DISTINCT number)), ',') AS pages FROM {book_pages} WHERE id % 11 IN (5, 6, 7) GROUP BY 1, 2""",
    "text_choice": r"""SELECT id, CAST(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) < 40 AND length(filename) + 82 > length(text) THEN length(filename) + 82 ELSE length(text) END AS BIGINT) AS size,
        concat(CASE WHEN regexp_extract(text, '^[A-Za-z]+') = '' THEN '' ELSE concat(regexp_extract(text, '^[A-Za-z]+'), ' · ') END, coalesce(url, 'Unidentified')) AS title FROM {book_pages}""",
    "json_properties": r"""SELECT event_id, try_cast(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS k FROM events""",
}


def oracle(name: str) -> str:
    return with_relations(SQL[name], VIEWS)


ORACLES = {name: oracle(name) for name in SQL}

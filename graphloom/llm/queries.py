"""The queries of this package and their SQL, as __spark_entry__ registers them."""

from .chaining import op10_collinear_chaining
from .column_bwt import op5_column_bwt
from .combinations import op13_least_squares_packing
from .nn_descent import op2_nn_descent
from .order_minhash import op8_order_minhash
from .packing import op4_best_fit_packing
from .ppm import op7_ppm_scoring
from .shallot import op11_shallot_clusters
from .shallot import oracle as shallot_oracle
from .tiling import op1_string_tiling
from .token_files import op6_token_files
from .toxicity import op3_boosted_toxicity
from .variants import ORACLE as VARIANTS_SQL
from .variants import op12_qchunk_variants
from .wrappers import op9_wrapper_induction

QUERIES = {
    f.__name__: f
    for f in (
        op1_string_tiling,
        op2_nn_descent,
        op3_boosted_toxicity,
        op4_best_fit_packing,
        op5_column_bwt,
        op6_token_files,
        op7_ppm_scoring,
        op8_order_minhash,
        op9_wrapper_induction,
        op10_collinear_chaining,
        op11_shallot_clusters,
        op12_qchunk_variants,
        op13_least_squares_packing,
    )
}
SQL: dict[str, str] = {
    "op2_nn_descent": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(d.n, 0) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
FROM roots r LEFT JOIN degrees d ON r.vec_id = d.vec_id
""",
    "op11_shallot_clusters": shallot_oracle(),
    "op12_qchunk_variants": VARIANTS_SQL,
}

"""Fixed values the computations depend on. Every one of them is a default parameter somewhere."""

# Label, thresholds and minimum sizes.
NEGATIVE_LABEL_MAX_SCORE = 3
LOW_SCORE_MAX = 2
LEADERBOARD_MIN_ORDERS = 10
SCORED_SELLER_MIN_ORDERS = 5
CATEGORY_MIN_ORDERS = 100
CATEGORY_TOP_N = 20
RANDOM_SEED = 42

# Seller score weights, they add up to 1.
SCORE_WEIGHTS = {
    "avg_review_score": 0.30,
    "on_time_delivery_rate": 0.25,
    "low_complaint_rate": 0.15,
    "delivery_speed": 0.15,
    "order_volume": 0.10,
    "cancel_rate_penalty": 0.05,
}

# Grade labels with the lowest score of each, best first.
SCORE_GRADES = [
    (80, "A — Highly trusted"),
    (65, "B — Trusted"),
    (50, "C — Mixed"),
    (35, "D — Risky"),
    (0, "F — High risk"),
]

# Delivery margin (days) buckets, the last one takes everything lower.
DELIVERY_BUCKETS = [
    (5, "1. Early (5+ days)"),
    (0, "2. On time"),
    (-5, "3. Late (<5 days)"),
    (None, "4. Very late (5+ days)"),
]

# The model's input columns, in order.
FEATURE_COLUMNS = [
    "price_total",
    "freight_total",
    "freight_ratio",
    "n_items",
    "n_sellers",
    "n_categories",
    "product_weight_g",
    "product_volume_cm3",
    "product_photos_qty",
    "product_description_lenght",
    "delivery_days",
    "approval_delay_hours",
    "estimated_delivery_days",
    "purchase_dow",
    "purchase_month",
    "payment_installments",
    "payment_value",
    "seller_avg_review_hist",
    "customer_state_code",
]

# Portuguese polarity words and negators.
POSITIVE_WORDS = (
    "bom boa otimo ótima ótimo otima excelente perfeito perfeita maravilhoso maravilhosa recomendo "
    "satisfeito satisfeita rapido rápida rápido rapida amei adorei gostei lindo linda qualidade super "
    "feliz facil fácil confiavel confiável agil ágil top"
).split()
NEGATIVE_WORDS = (
    "ruim pessimo péssimo pessima péssima horrivel horrível demora demorou atraso atrasado atrasada "
    "nao não nunca quebrado quebrada defeito errado errada decepcao decepção decepcionado pessimamente "
    "estorno reclamacao reclamação problema cancelado devolver devolucao devolução enganado lixo "
    "arrependido pior"
).split()
NEGATOR_WORDS = "nao não nunca nem jamais".split()
# Dotless i and long s also match a-z when letter case is ignored.
WORD_PATTERN = "[a-zà-úıſ]+"
POLARITY_MARGIN = 0.05

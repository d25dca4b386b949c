"""Table operators: fault injection (C), comparison (D), data quality (E),
structural diff (F), diagnosis (G), before/after outcome (H), assurance (I)."""

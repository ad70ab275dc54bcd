"""Scalar functions of the market, venue and ledger data, as Column expressions."""

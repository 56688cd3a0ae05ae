"""Column expressions shared by operators and marts."""

from ordermill.functions.columns import (
    days_between,
    line_amount,
    line_cents,
    mean,
    mean_of_cents,
    money,
    money_of_cents,
    price_cents,
    sale_date,
)

__all__ = [
    "days_between",
    "line_amount",
    "line_cents",
    "mean",
    "mean_of_cents",
    "money",
    "money_of_cents",
    "price_cents",
    "sale_date",
]

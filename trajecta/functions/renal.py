"""Filtration-rate estimates. male and black are 0/1, age in years, creatinine in mg/dL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published MDRD and CKD-EPI equations.
MDRD_SCALE, MDRD_CREATININE, MDRD_AGE, MDRD_FEMALE, MDRD_BLACK = 175.0, -1.154, -0.203, 0.742, 1.212
EPI_SCALE, EPI_AGE, EPI_FEMALE, EPI_BLACK = 141.0, 0.993, 1.018, 1.159
EPI_KAPPA_FEMALE, EPI_KAPPA_MALE, EPI_ALPHA_FEMALE, EPI_ALPHA_MALE, EPI_STEEP = 0.7, 0.9, -0.329, -0.411, -1.209


def _mdrd_factor(male: Column, black: Column, age: Column) -> Column:
    return F.lit(MDRD_SCALE) * F.pow(age, F.lit(MDRD_AGE)) * F.when(male == 1, 1.0).otherwise(MDRD_FEMALE) * F.when(black == 1, MDRD_BLACK).otherwise(1.0)


def gfr_mdrd(creatinine: Column, male: Column, black: Column, age: Column) -> Column:
    return _mdrd_factor(male, black, age) * F.pow(creatinine, F.lit(MDRD_CREATININE))


def creatinine_at_gfr_mdrd(gfr: Column, male: Column, black: Column, age: Column) -> Column:
    return F.pow(gfr / _mdrd_factor(male, black, age), F.lit(1 / MDRD_CREATININE))


def creatinine_at_gfr_epi(gfr: Column, male: Column, black: Column, age: Column) -> Column:
    """Inverse of CKD-EPI: the shallow branch holds where its own creatinine lies under kappa."""
    kappa = F.when(male == 1, EPI_KAPPA_MALE).otherwise(EPI_KAPPA_FEMALE)
    alpha = F.when(male == 1, EPI_ALPHA_MALE).otherwise(EPI_ALPHA_FEMALE)
    factor = F.lit(EPI_SCALE) * F.pow(F.lit(EPI_AGE), age) * F.when(male == 1, 1.0).otherwise(EPI_FEMALE) * F.when(black == 1, EPI_BLACK).otherwise(1.0)
    ratio = gfr / factor
    return kappa * F.when(ratio > 1, F.pow(ratio, 1 / alpha)).otherwise(F.pow(ratio, F.lit(1 / EPI_STEEP)))

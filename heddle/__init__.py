"""Textile colour-separation and mill-ledger jobs as Spark DataFrame programs."""

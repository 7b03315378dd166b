"""Tidewatch: DataFrame operators for many versions of many listings."""

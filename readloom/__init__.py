"""Spark-native preprocessing of selection sequencing reads."""

__version__ = "0.1.0"

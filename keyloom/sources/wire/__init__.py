"""Wire format of keyed-record containers, in plain Python without Spark."""

"""Record linkage and training-data preparation for postal addresses, expressed as Spark plans."""

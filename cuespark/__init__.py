"""cuespark: does a corpus still carry a group signal once its explicit cues are gone?

Posts are filtered, labelled, scrubbed, audited, embedded, split and classified as Spark
DataFrame jobs.  See README.md for a tour.
"""

"""carryover: move tables from one schema to another and prove that every value arrived.

Users describe each table once (:mod:`carryover.spec`); everything else is
ordinary DataFrame work built from that description.
"""

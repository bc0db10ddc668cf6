"""symgraph.streaming"""
